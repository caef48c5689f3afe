"""Capture files (pcap and pcapng) read in byte ranges, and written.

Records have no marks that a reader in the middle of a file could look for, so
reading has two phases.  First a task per file walks over the record headers,
skipping the frames, and notes about every RANGE_BYTES where a record begins,
its number in the file and what the reader must know there (byte order, link
types, time units).  Then the ranges of all files are dealt over the cluster and
decoded, each by a task of its own.
"""

from __future__ import annotations

import io
import json
import socket
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from flowloom.operators.session import cut

SCHEMA = (
    "file string, seq long, timestamp_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, "
    "ip_total_length int, ip_header_length int, transport_header_length int, payload_length long, tcp_flags int, "
    "tcp_window int, tcp_data_offset int, status string")

# fixed values: magic numbers of the file format -> (byte order, nanosecond times)
_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", False), b"\xa1\xb2\xc3\xd4": (">", False),
    b"\x4d\x3c\xb2\xa1": ("<", True), b"\xa1\xb2\x3c\x4d": (">", True),
}
# fixed values: block types and byte-order mark of the newer format
_SECTION, _INTERFACE, _SIMPLE, _ENHANCED = 0x0A0D0D0A, 1, 3, 6
_BYTE_ORDER = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
_ETHERNET, _RAW_IP = 1, (101, 12, 14)

#: A range ends with the first record that begins this many bytes behind its start, or later.
RANGE_BYTES = 16 << 20
#: Packets of a decoded Arrow batch.
BATCH_PACKETS = 8192

#: Bytes of a protocol's header that are read; a frame that ends before them is an error.
_LEAST_HEADER = {6: 16, 17: 8, 1: 4}


def decode_frame(frame: bytes, link_type: int) -> tuple:
    """(src, dst, sport, dport, proto, ip_len, ip_head, head, payload, flags, window, offset, status) of one frame."""
    nothing = (None,) * 12
    try:
        if link_type == _ETHERNET:
            kind, at = struct.unpack_from(">H", frame, 12)[0], 14
            while kind in (0x8100, 0x88A8):  # VLAN tags
                kind, at = struct.unpack_from(">H", frame, at + 2)[0], at + 4
            if kind != 0x0800:
                return (*nothing, "skipped")
        elif link_type in _RAW_IP:
            at = 0
            if frame[0] >> 4 != 4:
                return (*nothing, "skipped")
        else:
            return (*nothing, "skipped")
        ip_head = (frame[at] & 15) * 4
        if ip_head < 20:
            return (*nothing, "error")
        ip_len, frag, proto = (*struct.unpack_from(">H2xH", frame, at + 2), frame[at + 9])
        src, dst = socket.inet_ntoa(frame[at + 12:at + 16]), socket.inet_ntoa(frame[at + 16:at + 20])
        if len(frame) < at + 20:
            return (*nothing, "error")
        sport = dport = head = flags = window = offset = 0
        body = at + ip_head
        if frag & 0x1FFF == 0:  # only the first fragment carries the transport header
            if proto in _LEAST_HEADER and len(frame) < body + _LEAST_HEADER[proto]:
                return (*nothing, "error")
            if proto == 6:
                sport, dport = struct.unpack_from(">HH", frame, body)
                offset, flags, window = frame[body + 12] >> 4, frame[body + 13], struct.unpack_from(">H", frame, body + 14)[0]
                head = offset * 4
            elif proto == 17:
                sport, dport = struct.unpack_from(">HH", frame, body)
                head = 8
            elif proto == 1:
                head = 8
        return (src, dst, sport, dport, proto, ip_len, ip_head, head, max(ip_len - ip_head - head, 0), flags, window, offset, "ok")
    except (struct.error, IndexError, OSError):
        return (*nothing, "error")


def _options(body: bytes, order: str) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        out[code] = body[at + 4:at + 4 + size]
        at += 4 + size + -size % 4
    return out


#: What the reader knows at a record: the form of the file, and for the newer form its interfaces and the last time.
State = dict


def _open_path(path: str):
    """A seekable, buffered reader of a local path or a URI of any file system that Arrow knows."""
    from pyarrow import fs

    system, inner = (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_file(inner), 1 << 20)


def open_state(f) -> State | None:
    """The state behind a file's first header, or None where the file is no capture; *f* is left at its first record."""
    magic = f.read(4)
    if magic in _MAGIC:
        order, nano = _MAGIC[magic]
        header = f.read(20)
        if len(header) == 20:
            return {"order": order, "nano": nano, "link": struct.unpack(order + "HHiIII", header)[5] & 0xFFFF}
    elif magic == struct.pack("<I", _SECTION):
        f.seek(0)
        return {"order": "<", "links": [], "last": 0}
    return None


def _take(f, size: int, end: int, want: bool) -> bytes | None:
    """The next *size* bytes, or none of them (empty) when they are only passed over; None where the file ends before."""
    if f.tell() + size > end:
        f.seek(end)
        return None
    if want:
        return f.read(size)
    f.seek(size, 1)
    return b""


def classic_records(f, end: int, state: State, want: bool) -> Iterator[tuple[int | None, bytes | None, int]]:
    """(microseconds, frame, link type) of each packet up to byte *end*; a frame of None stands for a packet that is cut off."""
    link = state["link"]
    while record := f.read(min(16, end - f.tell())):
        if len(record) < 16:
            yield None, None, link
            return
        sec, frac, size, _ = struct.unpack(state["order"] + "IIII", record)
        yield sec * 1_000_000 + (frac // 1000 if state["nano"] else frac), _take(f, size, end, want), link


def block_records(f, end: int, state: State, want: bool) -> Iterator[tuple[int | None, bytes | None, int]]:
    """As ``classic_records``, of the newer form's blocks; simple packets have no time and take that of the packet before.

    Blocks are small next to their ranges, so they are read whole also when only passed over.
    """
    while head := f.read(min(8, end - f.tell())):
        if len(head) == 8 and head[:4] == struct.pack("<I", _SECTION):  # reads the same in both byte orders
            mark = f.read(4)
            if mark not in _BYTE_ORDER:
                yield None, None, 0
                return
            state["order"], state["links"] = _BYTE_ORDER[mark], []
            size = struct.unpack(state["order"] + "I", head[4:])[0]
            if size < 16 or _take(f, size - 12, end, False) is None:
                yield None, None, 0
                return
            continue
        order = state["order"]
        kind, size = struct.unpack(order + "II", head) if len(head) == 8 else (0, 0)
        block = _take(f, size - 8, end, True) if size >= 12 else None
        if block is None:
            yield None, None, 0
            return
        body = block[:-4]
        try:
            if kind == _INTERFACE:
                found = _options(body[8:], order)
                unit = found[9][0] if found.get(9) else 6  # the resolution: a power of ten, or of two with the top bit
                offset = struct.unpack(order + "q", found[14])[0] if len(found.get(14, b"")) == 8 else 0
                state["links"].append((struct.unpack_from(order + "H", body)[0], 2 ** (unit & 127) if unit & 128 else 10 ** unit, offset))
            elif kind == _ENHANCED:
                interface, high, low, kept = struct.unpack_from(order + "IIII", body)
                link, ticks, offset = state["links"][interface]
                state["last"] = offset * 1_000_000 + ((high << 32) + low) * 1_000_000 // ticks
                yield state["last"], body[20:20 + kept] if len(body) >= 20 + kept else None, link
            elif kind == _SIMPLE:
                size = struct.unpack_from(order + "I", body)[0]
                yield state["last"], body[4:4 + size], state["links"][0][0]
        except (struct.error, IndexError):
            yield None, None, 0


def records(f, end: int, state: State | None, want: bool = True) -> Iterator[tuple[int | None, bytes | None, int]]:
    if state is None:
        return iter([(None, None, 0)])
    return (block_records if "links" in state else classic_records)(f, end, state, want)


def ranges_of(f, size: int, range_bytes: int) -> Iterator[tuple[int, int, int, str]]:
    """(begin, end, number of the first packet, state) of a file's ranges: every packet is in one of them."""
    state = open_state(f)
    begin, first, known = f.tell(), 0, json.dumps(state)
    n = 0
    for n, _ in enumerate(records(f, size, state, False), 1):
        if f.tell() - begin >= range_bytes and f.tell() < size:
            yield begin, f.tell(), first, known
            begin, first, known = f.tell(), n, json.dumps(state)
    if n > first or state is None:
        yield begin, size, first, known


def _index(paths: DataFrame, range_bytes: int) -> DataFrame:
    def walk(batches):
        import pyarrow as pa

        for batch in batches:
            for path, rank in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open_path(path) as f:
                    size = f.seek(0, 2)
                    f.seek(0)
                    found = list(zip(*ranges_of(f, size, range_bytes)))
                n = len(found[0]) if found else 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array([rank] * n, pa.int64()),
                     *[pa.array(c, t) for c, t in zip(found or [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]],
                    names=["path", "rank", "begin", "end", "first", "state"])

    return paths.mapInArrow(walk, "path string, rank long, begin long, end long, first long, state string")


def _decoded(ranges: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def decode(batches):
        import pyarrow as pa

        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for n, c in zip(names, SCHEMA.split(", "))])
        for batch in batches:
            for r in batch.to_pylist():
                with _open_path(r["path"]) as f:
                    f.seek(r["begin"])
                    part = io.BytesIO(f.read(r["end"] - r["begin"]))
                rows, name = [], r["path"].rsplit("/", 1)[-1]
                for i, (at, frame, link) in enumerate(records(part, r["end"] - r["begin"], json.loads(r["state"])), r["first"]):
                    packet = (None,) * 12 + ("error",) if frame is None else decode_frame(frame, link)
                    rows.append((name, (r["rank"] << 40) + i, at, *packet))
                    if len(rows) == BATCH_PACKETS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names=names)

    return ranges.mapInArrow(decode, SCHEMA)


def _matches(spark: SparkSession, glob: str) -> list[str]:
    """Paths that match, in order of their file names; found by Hadoop, so any file system that Spark lists will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = [f.getPath().toString() for f in found if f.isFile() and not f.getPath().getName().startswith((".", "_"))]
    local = [n.removeprefix("file:") if n.startswith("file:") else n for n in names]
    return sorted(("/" + n.lstrip("/") if "://" not in n else n for n in local), key=lambda p: (p.rsplit("/", 1)[-1], p))


def read_captures(spark: SparkSession, glob: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Packets of all capture files matching *glob*, one task for about every *range_bytes*.

    ``seq`` numbers packets over all files in file-name order: the file's rank
    in the upper bits, the position in the file below, so no ordering pass is
    needed.  Frames that are not IPv4 or cannot be decoded stay as rows with
    ``status`` skipped/error; a packet that is cut off and a file that is no
    capture are one error row each.
    """
    paths = _matches(spark, glob)
    if not paths:
        raise FileNotFoundError("no capture files match the path")
    files = spark.createDataFrame(list(zip(paths, range(len(paths)))), "path string, rank long")
    ranges = cut(_index(files.repartition(min(len(paths), 10_000), "path"), range_bytes))
    tasks = max(1, min(ranges.count(), 100_000))
    return _decoded(ranges.repartitionByRange(tasks, "rank", "begin"))


# --- writing ------------------------------------------------------------------------------

def encode_frame(p: dict) -> tuple[bytes, int]:
    """An Ethernet frame with the packet's headers, and its length on the wire; of the payload only the length is known."""
    tcp, udp = p["protocol"] == 6, p["protocol"] == 17
    if tcp:
        head = struct.pack(">HHIIBBHHH", p["src_port"], p["dst_port"], 0, 0, (p["tcp_data_offset"] & 15) << 4, p["tcp_flags"], p["tcp_window"], 0, 0)
        head = head.ljust(max(20, 4 * p["tcp_data_offset"]), b"\0")
    elif udp:
        head = struct.pack(">HHHH", p["src_port"], p["dst_port"], min(8 + p["payload_length"], 65535), 0)
    else:
        head = bytes(8 if p["protocol"] == 1 else 0)
    total = 20 + len(head) + p["payload_length"]
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, total, 0, 0, 64, p["protocol"], 0, socket.inet_aton(p["src_ip"]), socket.inet_aton(p["dst_ip"]))
    return bytes(12) + struct.pack(">H", 0x0800) + ip + head, 14 + total


def _file_head(form: str) -> bytes:
    if form == "pcap":
        return b"\xd4\xc3\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, 65535, _ETHERNET)
    section = struct.pack("<IIIHHqI", _SECTION, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    return section + struct.pack("<IIHHII", _INTERFACE, 20, _ETHERNET, 0, 65535, 20)


def _file_record(form: str, at: int, frame: bytes, size: int) -> bytes:
    if form == "pcap":
        return struct.pack("<IIII", at // 1_000_000, at % 1_000_000, len(frame), size) + frame
    length = 32 + len(frame) + -len(frame) % 4
    return struct.pack("<IIIIIII", _ENHANCED, length, 0, at >> 32, at & 0xFFFFFFFF, len(frame), size) + frame + bytes(-len(frame) % 4) + struct.pack("<I", length)


def write_captures(packets: DataFrame, folder: str, form: str = "pcap") -> DataFrame:
    """One capture file per partition of *packets* (``pcap`` or ``pcapng``), packets in time order: (file, packets) of each.

    A file's name is its partition's number, so a task that runs again replaces its file.
    """
    if form not in ("pcap", "pcapng"):
        raise ValueError(f"unknown form {form!r}")
    needed = ["seq", "timestamp_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "payload_length", "tcp_flags", "tcp_window", "tcp_data_offset"]

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        system, inner = (fs.LocalFileSystem(), folder) if "://" not in folder else fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():05d}.{form}", 0
        with system.open_output_stream(f"{inner}/{name}") as f:
            f.write(_file_head(form))
            for batch in batches:
                rows = batch.to_pylist()
                f.write(b"".join(_file_record(form, p["timestamp_us"], *encode_frame(p)) for p in rows))
                n += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "packets"])

    ordered = packets.select(*needed).sortWithinPartitions("timestamp_us", "seq")
    return cut(ordered.mapInArrow(write, "file string, packets long"))
