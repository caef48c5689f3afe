"""Streaming flow assembly in event-time order: bounded state per key, event-time limits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.operators.packets import KEY, PACKETS, with_flow_key
from flowloom.streaming.ordered import close_input, in_event_order

FLOW_COLUMNS = (
    "ip_a string, port_a int, ip_b string, port_b int, protocol int, src_ip string, src_port int, dst_ip string, dst_port int, "
    "start_us long, end_us long, packet_count long, state string, tcp_state string, close_reason string, half_open boolean, "
    + ", ".join(f"{c} double" for c in fv.FEATURE_COLUMNS))


def stream_packets(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Packet rows from Parquet files that keep arriving in a folder."""
    return spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _push(m: list, x: float) -> None:
    """Running count, mean, squared deviation, sum, minimum, maximum (Welford)."""
    m[0] += 1
    d = x - m[1]
    m[1] += d / m[0]
    m[2] += d * (x - m[1])
    m[3] += x
    m[4] = x if m[0] == 1 else min(m[4], x)
    m[5] = x if m[0] == 1 else max(m[5], x)


def _mean(m: list) -> float:
    return m[3] / m[0] if m[0] else 0.0


def _std(m: list) -> float:
    return math.sqrt(max(m[2], 0.0) / m[0]) if m[0] > 1 else 0.0


def _open(p) -> dict:
    zero = lambda: [0, 0.0, 0.0, 0.0, 0.0, 0.0]
    return {
        "src": [p.src_ip, p.src_port, p.dst_ip, p.dst_port], "side": p.side, "start": p.timestamp_us, "last": p.timestamp_us,
        "size": [zero(), zero(), zero()], "gap": [zero(), zero(), zero()], "idle": zero(), "seen": [None, None],
        "head": [0, 0], "window": [None, None], "flags": 0, "data": 0, "offset": 0, "fin": [False, False], "syn": False,
        "end": False, "active": 0, "bursts": 0, "in_burst": False}


def _add(f: dict, p) -> bool:
    """Take one packet into the flow; True when the packet closes it."""
    tcp, back = p.protocol == fv.TCP, int(p.side != f["side"])
    size = max(int(p.payload_length), 0)
    _push(f["size"][2], size)
    _push(f["size"][back], size)
    if f["size"][2][0] > 1:
        gap = p.timestamp_us - f["last"]
        _push(f["gap"][2], gap)
        if gap >= fv.BURST_GAP_US:
            _push(f["idle"], gap)
            f["in_burst"] = False
        elif gap > 0:
            f["active"] += gap
            f["bursts"] += not f["in_burst"]
            f["in_burst"] = True
    if f["seen"][back] is not None:
        _push(f["gap"][back], p.timestamp_us - f["seen"][back])
    f["seen"][back] = f["last"] = p.timestamp_us
    f["head"][back] += int(p.ip_header_length + p.transport_header_length)
    f["flags"] |= int(p.tcp_flags)
    if not tcp:
        return False
    if f["window"][back] is None:
        f["window"][back] = int(p.tcp_window)
    if not back:
        f["data"] += size >= 1
        if p.tcp_data_offset > 0:
            f["offset"] = min(f["offset"] or int(p.tcp_data_offset), int(p.tcp_data_offset))
    f["syn"] |= bool(p.tcp_flags & fv.SYN)
    f["end"] |= bool(p.tcp_flags & (fv.FIN | fv.RST))
    if p.tcp_flags & fv.FIN:
        f["fin"][back] = True
    return bool(p.tcp_flags & fv.RST) or all(f["fin"])


def _half_open(f: dict) -> bool:
    return f["size"][1][0] == 0 and not f["end"]


def _row(key: tuple, f: dict, reason: str) -> tuple:
    fwd, bwd, both = f["size"]
    gf, gb, ga = f["gap"]
    us = f["last"] - f["start"]
    per_s = lambda x: x / (us / 1e6) if us > 0 else 0.0
    bit = lambda b: float(bool(f["flags"] & b))
    features = (
        f["src"][3], us, fwd[0], bwd[0], fwd[3], bwd[3], fwd[5], fwd[4], _mean(fwd), _std(fwd), bwd[4], _std(bwd),
        per_s(fwd[3] + bwd[3]), per_s(both[0]), _std(ga), ga[4], gf[3], _std(gf), gf[4], gb[3], _std(gb), gb[4],
        f["head"][0], f["head"][1], per_s(bwd[0]), both[5], _mean(both), _std(both),
        bit(fv.FIN), bit(fv.PSH), bit(fv.ACK), bit(fv.URG), bwd[0] / fwd[0] if fwd[0] else 0.0,
        f["window"][0] or 0, f["window"][1] or 0, f["data"], 4 * f["offset"],
        f["active"] / f["bursts"] if f["bursts"] else 0.0, _mean(f["idle"]), _std(f["idle"]))
    tcp_state = "CLOSING" if f["end"] else "ESTABLISHED" if f["syn"] else "NEW"
    state = "TIMEOUT" if reason == "timeout" else "COMPLETED"
    return (*key, *f["src"], f["start"], f["last"], both[0], state, tcp_state, reason, _half_open(f), *map(float, features))


def stream_flows(
    packets: DataFrame, late: str = "10 seconds", idle_s: float = 120, half_open_idle_s: float = 5,
) -> DataFrame:
    """Finished flows of a packet stream, same columns and values as the live batch operator.

    Packets may arrive in any order within *late*: each waits until the watermark
    has passed it and is then taken by (time, seq), so shuffled files give what the
    batch operator gives on the same rows.  A key's state is the packets that wait
    and its open flow as running moments, whose size does not grow with the flow;
    it is gone when the flow has ended.  A flow ends on RST, on FIN from both
    sides, when a packet comes after too long a silence, or when the watermark
    passes its limit.  Packets later than *late* are dropped by the watermark.
    ``close_packets`` ends the stream and with it the flows that are open.
    """
    idle, half = int(idle_s * 1e6), int(half_open_idle_s * 1e6)

    def limit(f):
        return half if _half_open(f) else idle

    def step(key, flow, rows, mark):
        for p in rows:
            if flow is not None and p.timestamp_us - flow["last"] > limit(flow):
                yield _row(key, flow, "timeout")
                flow = None
            flow = _open(p) if flow is None else flow
            if _add(flow, p):
                yield _row(key, flow, "rst" if p.tcp_flags & fv.RST else "fin")
                flow = None
        if flow is not None and mark >= flow["last"] + limit(flow):  # any packet to come is beyond the limit
            yield _row(key, flow, "timeout")
            flow = None
        return flow, None if flow is None else flow["last"] + limit(flow)

    return in_event_order(with_flow_key(packets), list(KEY), F.col("timestamp_us"), ["seq"], step, FLOW_COLUMNS, late)


def close_packets(spark: SparkSession, path: str) -> None:
    """End the packet stream of a folder: flows that are open end by silence."""
    close_input(spark, path, PACKETS, "timestamp_us")
