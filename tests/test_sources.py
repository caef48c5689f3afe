"""Files in and out."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.operators import clean as cl
from flowloom.operators import flows as fl
from flowloom.operators.packets import accept_packets
from flowloom.operators.packets import packet_stats
from flowloom.plans import views
from flowloom.sources import files, sinks
from flowloom.sources.captures import read_captures, write_captures
from tests.test_flows import C, S

SF = "/root/testdata/sf0.001"


def write_csv(folder, name, rows, header=" Destination Port, Flow Duration, Label"):
    text = header + "\n" + "\n".join(",".join(r) for r in rows) + "\n"
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)
    return text


def test_labelled_csv(spark, new_dir):
    text = write_csv(new_dir, "Monday-a.csv", [(str(i), str(i * 10), "BENIGN") for i in range(50)])
    write_csv(new_dir, "Friday-b.csv", [("1", "2", "Bot"), ("3", "4", "DoS Hulk")])
    df = files.read_labelled_csv(spark, new_dir, expected_files=2, expected_cols=3)
    assert df.columns == ["destination_port", "flow_duration", *fv.PROVENANCE, "Label"]
    assert all(r._source_row == int(r.destination_port) for r in df.filter("_capture_day = 'monday'").collect())
    sums = {r.file: (r.bytes, r.sha256) for r in files.file_checksums(spark, new_dir).collect()}
    assert sums["Monday-a.csv"] == (len(text), hashlib.sha256(text.encode()).hexdigest())
    manifest = {r.file: (r.rows, r.labels) for r in files.file_manifest(spark, new_dir, df).collect()}
    assert manifest["Friday-b.csv"] == (2, {"Bot": 1, "DoS Hulk": 1})
    for kw in (dict(expected_files=3, expected_cols=3), dict(expected_files=2, expected_cols=4)):
        with pytest.raises(ValueError):
            files.read_labelled_csv(spark, new_dir, **kw)
    for header in ("A,B,C", "A,A,Label", "A,B,Label"):
        with pytest.raises(ValueError):
            files.validate_labelled({"x": (["Destination Port", "Flow Duration", "Label"], 1), "y": (header.split(","), 1)}, 2, 3)


def test_row_numbers_over_many_blocks(spark, new_dir):
    write_csv(new_dir, "Monday-a.csv", [(str(i), "1", "BENIGN") for i in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = files.read_labelled_csv(spark, new_dir, 1, 3)
        assert df.filter("_source_row <> cast(destination_port as long)").isEmpty() and df.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cleaned_round_trip(spark, new_dir):
    write_csv(new_dir, "Monday-a.csv", [("1", "2", "BENIGN"), ("3", "4", "Bot")])
    rows, audit = cl.clean(files.read_labelled_csv(spark, new_dir, 1, 3))
    sinks.write_cleaned(rows, new_dir + "/out")
    sinks.write_audit(audit, new_dir + "/audit")
    back = files.read_cleaned(spark, new_dir + "/out")
    assert back.columns == ["destination_port", "flow_duration", *fv.PROVENANCE, "Label"] and back.count() == 2
    assert spark.read.json(new_dir + "/audit").first().output_rows == 2
    rows.limit(0).write.parquet(new_dir + "/empty")
    with pytest.raises(ValueError):
        files.read_cleaned(spark, new_dir + "/empty")


def frame(src, dst, proto, body):
    total = 20 + len(body)
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, total, 0, 0, 64, proto, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return b"\0" * 12 + b"\x08\x00" + ip + body


def tcp_body(sp, dp, flags, window, payload):
    return struct.pack(">HHIIBBHHH", sp, dp, 0, 0, 5 << 4, flags, window, 0, 0) + b"x" * payload


def test_captures(spark, new_dir):
    talk = [(0, C, S, 2, 8192, 0), (100_000, S, C, 18, 65535, 0), (200_000, C, S, 16, 8192, 0), (300_000, C, S, 24, 8192, 100),
            (400_000, S, C, 24, 65535, 200), (500_000, C, S, 17, 8192, 0), (600_000, S, C, 17, 65535, 0)]
    frames = [(t, frame(a[0], b[0], 6, tcp_body(a[1], b[1], fl_, w, n))) for t, a, b, fl_, w, n in talk]
    frames += [(700_000, b"\0" * 12 + b"\x08\x06" + b"\0" * 28), (800_000, frame("10.0.0.1", "10.0.0.2", 17, struct.pack(">HHHH", 53000, 53, 58, 0) + b"q" * 50)),
               (900_000, b"\0" * 12 + b"\x08\x00\x45\x00")]
    for name, order in (("a.pcap", "<"), ("b.pcap", ">")):
        with open(f"{new_dir}/{name}", "wb") as f:
            f.write(struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
            for t, data in frames:
                f.write(struct.pack(order + "IIII", t // 1_000_000, t % 1_000_000, len(data), len(data)) + data)
    both = read_captures(spark, new_dir + "/*.pcap")
    assert tuple(packet_stats(both).first()) == (20, 16, 2, 2)
    assert both.select("seq").distinct().count() == 20
    packets = accept_packets(both.filter("file = 'a.pcap'"))
    flows = {r.protocol: r for r in fl.assemble_flows(packets).collect()}
    assert flows[6].packet_count == 7 and flows[6].close_reason == "fin" and flows[6].total_length_of_bwd_packets == 200
    assert flows[6].init_win_bytes_backward == 65535 and flows[17].total_length_of_fwd_packets == 50 and flows[17].fwd_header_length == 28


def test_newer_captures_and_damaged_ones(spark, new_dir):
    data = frame("10.0.0.1", "10.0.0.2", 17, struct.pack(">HHHH", 53000, 53, 58, 0) + b"q" * 50)
    cut_tcp = frame("10.0.0.1", "10.0.0.2", 6, b"\0" * 10)
    for name, order in (("a.pcapng", "<"), ("b.pcapng", ">")):
        def block(kind, body):
            body += b"\0" * (-len(body) % 4)
            return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)
        packet = lambda i, t, d: block(6, struct.pack(order + "IIIII", i, t >> 32, t & 0xFFFFFFFF, len(d), len(d)) + d)
        nano = struct.pack(order + "HH", 9, 1) + bytes([9, 0, 0, 0]) + struct.pack(order + "HH", 0, 0)
        whole = (block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(order + "HHI", 1, 0, 0))
                 + block(1, struct.pack(order + "HHI", 1, 0, 0) + nano) + packet(0, 5_000_000, data) + block(5, b"\0" * 12)
                 + packet(1, 7_000_000_000, cut_tcp) + block(3, struct.pack(order + "I", len(data)) + data))
        with open(f"{new_dir}/{name}", "wb") as f:
            f.write(whole + packet(0, 9_000_000, data)[:30])
    with open(f"{new_dir}/c.pcap", "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 1, 2, len(data), len(data)) + data[:20])
    with open(f"{new_dir}/d.pcap", "wb") as f:
        f.write(b"no capture")
    got = [(r.file, r.seq & 0xFF, r.timestamp_us, r.src_port, r.status) for r in read_captures(spark, new_dir + "/*").orderBy("seq").collect()]
    one = [(0, 5_000_000, 53000, "ok"), (1, 7_000_000, None, "error"), (2, 7_000_000, 53000, "ok"), (3, None, None, "error")]
    assert got == [("a.pcapng", *r) for r in one] + [("b.pcapng", *r) for r in one] + [("c.pcap", 0, 1_000_002, None, "error"), ("d.pcap", 0, None, None, "error")]
    assert tuple(packet_stats(read_captures(spark, new_dir + "/*")).first()) == (10, 4, 0, 6)


@pytest.mark.parametrize("form", ["pcap", "pcapng"])
def test_captures_split_into_ranges(spark, new_dir, make_packets, form):
    """Any range length gives the same packets with the same numbers; a file is read by many tasks."""
    rows = [(i, 10**12 + 37 * i, "10.0.0.1", 1000 + i % 50, "10.0.0.2", 80, i % 32, i % 300) for i in range(500)]
    rows += [((500 + i, 10**12 + 37 * (500 + i), "10.0.0.3", 53, "10.0.0.4", 53, 0, i), {"proto": 17}) for i in range(20)]
    packets = make_packets(rows)
    files = write_captures(packets.repartition(2), new_dir + "/in", form).collect()
    assert sum(r.packets for r in files) == 520 and len(files) == 2
    with open(f"{new_dir}/in/{files[0].file}", "ab") as f:
        f.write(b"cut off")
    read = lambda n: read_captures(spark, f"{new_dir}/in/*.{form}", n)
    show = lambda d: sorted(tuple(r) for r in d.collect())
    whole = show(read(1 << 30))
    assert len(whole) == 521 and sum(r[-1] == "error" for r in whole) == 1
    for n in (1, 100, 4096):
        part = read(n)
        assert show(part) == whole
    assert read(4096).rdd.getNumPartitions() > 8
    back = read(100).filter("status = 'ok'").select("timestamp_us", "src_port", "payload_length", "tcp_flags", "transport_header_length")
    want = packets.select("timestamp_us", "src_port", "payload_length", "tcp_flags", "transport_header_length")
    assert show(back) == show(want)


def test_log_appends_once(spark, new_dir):
    rows = views.attack_log_v(spark, SF).select(*[F.col(c) for c in (
        "attack_type", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "confidence", "is_attack", "flow_id")], F.col("timestamp_utc").cast("double"))
    path = new_dir + "/log"
    for batch, query in ((0, "a"), (1, "a"), (1, "a"), (0, "b")):
        sinks.append_predictions(rows, path, batch, query)
    assert sinks.read_log(spark, path).count() == 3 * rows.count()
    twins = rows.limit(1).unionByName(rows.limit(1))
    sinks.append_predictions(twins, path + "2", 0, "a")
    assert sinks.read_log(spark, path + "2").select("id").distinct().count() == 2
    sinks.reset_log(spark, path)
    assert sinks.read_log(spark, path).count() == 0


def test_compaction(spark, new_dir):
    import datetime
    import glob

    from flowloom.sources import compaction

    day = 86400.0

    def batch(number, first, days=3):
        return spark.range(30 * days).select(
            F.lit("DDoS").alias("attack_type"), F.lit("10.0.0.1").alias("src_ip"), F.lit("10.0.0.2").alias("dst_ip"), F.lit(1).alias("src_port"),
            F.lit(2).alias("dst_port"), F.lit(6).alias("protocol"), F.lit(0.9).alias("confidence"), F.lit(1).alias("is_attack"),
            F.concat(F.lit(f"{number}-"), F.col("id").cast("string")).alias("flow_id"), ((F.col("id") % days + first) * day).alias("timestamp_utc"))

    for n in range(6):
        sinks.append_predictions(batch(n, 0), new_dir, n, "a")
    rows = lambda: sorted(tuple(r) for r in sinks.read_log(spark, new_dir).collect())
    files = lambda d: len(glob.glob(f"{new_dir}/_compacted/data/*/day={d}/*.parquet"))
    before, open_reader = rows(), sinks.read_log(spark, new_dir)
    assert sinks.compact_log(spark, new_dir, datetime.date(1970, 1, 3)) == 2  # the third day is still open
    assert rows() == before and files("1970-01-01") == 1 and files("1970-01-03") == 0
    assert sorted(tuple(r) for r in open_reader.collect()) == before  # a reader from before the swap
    assert sinks.compact_log(spark, new_dir, datetime.date(1970, 1, 3)) == 0
    sinks.append_predictions(batch(3, 0), new_dir, 3, "a")  # a batch that was rewritten is repeated
    assert rows() == before
    sinks.append_predictions(batch(9, 0, days=1), new_dir, 9, "a")  # a late one
    late = rows()
    assert len(late) == len(before) + 30
    assert sinks.compact_log(spark, new_dir, datetime.date(1970, 1, 3), file_rows=50) == 1
    assert rows() == late
    # a compaction that died: data without a manifest, and a manifest without its end
    batch(1, 0).selectExpr("*").write.parquet(f"{new_dir}/_compacted/data/generation=dead/day=1970-01-01")
    spark.createDataFrame([], compaction.MANIFEST).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{new_dir}/_compacted/manifest/99")
    assert rows() == late
    sinks.append_predictions(batch(10, 0, days=1), new_dir, 10, "a")
    late = rows()
    assert sinks.compact_log(spark, new_dir, datetime.date(1970, 1, 3), file_rows=50) == 1 and rows() == late
    assert compaction.vacuum(spark, new_dir) > 0 and rows() == late
    assert not glob.glob(f"{new_dir}/day=1970-01-0[12]/*/*/*.parquet") and not glob.glob(f"{new_dir}/_compacted/data/generation=dead/day=*")
    sinks.append_predictions(batch(3, 0), new_dir, 3, "a")  # and once more after the folders are gone
    assert rows() == late
    plan = sinks.read_log(spark, new_dir).filter("day = date'1970-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(day") >= 2
    sinks.reset_log(spark, new_dir)
    assert rows() == []


def test_exports(spark, new_dir):
    log = views.attack_log_v(spark, SF)
    sinks.export_attacks_csv(log.withColumn("attack_type", F.when(F.col("id") == 3, "a,b").otherwise(F.col("attack_type"))).coalesce(1), new_dir + "/csv")
    lines = [r[0] for r in spark.read.text(new_dir + "/csv").collect()]
    assert lines[0] == "Time,Type,Source,Destination,Proto,Confidence" and len(lines) == log.count() + 1 and any('"a,b"' in x for x in lines)
    sinks.write_predictions_jsonl(log, new_dir + "/jsonl", max_flows=7)
    assert spark.read.json(new_dir + "/jsonl").count() == 7


def test_log_reads_its_newest_days_only(spark, new_dir):
    from flowloom.operators import log as lg

    day = 86_400
    rows = spark.range(0, 400).select(
        F.lit("DDoS").alias("attack_type"), F.lit("10.0.0.1").alias("src_ip"), F.lit("10.0.0.2").alias("dst_ip"), F.lit(1).alias("src_port"),
        F.lit(2).alias("dst_port"), F.lit(6).alias("protocol"), F.lit(0.9).alias("confidence"), (F.col("id") % 2).cast("int").alias("is_attack"),
        F.col("id").cast("string").alias("flow_id"), (F.col("id") * (day / 10.0)).alias("timestamp_utc"))  # ten rows a day
    sinks.append_predictions(rows, new_dir, 0, "a")
    log = sinks.read_log(spark, new_dir)
    plain = log.drop("day")
    for ask in (lambda d: lg.recent(d, 7), lambda d: lg.recent_attacks(d, 12), lambda d: lg.attack_history(d, 5, 20), lg.threat_level, lambda d: lg.threat_level(d, as_of=39.5 * day)):
        got = ask(log)
        assert got.drop("day").collect() == ask(plain).collect()
        filters = got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
        assert "day" in filters and ">=" in filters
    assert lg.recent(log, 1000).count() == 400 and lg.threat_level(log.limit(0)).first().threat_level == "SAFE"


def test_headers_are_read_without_sorting_the_lines(spark, new_dir):
    """One header a file, also in a file of several blocks; no operator sorts or groups the lines."""
    import contextlib
    import io
    import os

    from flowloom.sources import files

    os.makedirs(new_dir + "/csv", exist_ok=True)
    for name, header in (("a.csv", "x,Label"), ("b.csv", " x ,Label"), ("c.csv", "y,Label")):
        with open(f"{new_dir}/csv/{name}", "w") as f:
            f.write(header + "\n" + "1,BENIGN\n" * 5000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    frame = type(spark.range(1))
    plans, grouped = io.StringIO(), frame.groupBy
    try:
        frame.groupBy = lambda df, *cols: (df.explain(), grouped(df, *cols))[1]
        with contextlib.redirect_stdout(plans):
            found = files.csv_headers(spark, new_dir + "/csv")
    finally:
        frame.groupBy = grouped
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {"a.csv": (["x", "Label"], 1), "b.csv": (["x", "Label"], 1), "c.csv": (["y", "Label"], 1)}
    assert "MapInArrow" in plans.getvalue() and "Sort" not in plans.getvalue() and "Aggregate" not in plans.getvalue()
