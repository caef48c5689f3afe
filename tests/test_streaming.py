"""Streams give what the batch operators give on the same rows."""

from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.operators import flows as fl
from flowloom.operators import rules as ru
from flowloom.operators import series as se
from flowloom.plans import views
from flowloom.plans.stream_queries import _arrivals
from flowloom.sources.sinks import read_log
from flowloom.streaming import detect as sd
from flowloom.streaming import flows as sf
from flowloom.streaming.ordered import close_input

SF = "/root/testdata/sf0.001"


def run(df, path, spark, mode="append"):
    return run_to_end(df, path, spark, mode)[0]


def run_to_end(df, path, spark, mode="append"):
    q = df.writeStream.format("parquet").option("path", path + "/out").option("checkpointLocation", path + "/cp").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.read.schema(df.schema).parquet(path + "/out"), [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]


def shuffled(spark, df, at, late, path, files=4):
    """Files in order of arrival; a row arrives up to *late* after its time."""
    _arrivals(spark, df, F.col(at), late, files, path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_flows_equals_batch_on_shuffled_packets(spark, new_dir):
    packets = views.packets_v(spark, SF).withColumn("ip_total_length", F.lit(0)).select(*sf.PACKETS.names)
    packets = packets.select(*[F.col(f.name).cast(f.dataType) for f in sf.PACKETS.fields])
    shuffled(spark, packets, "timestamp_us", 9_000_000, new_dir + "/in")
    sf.close_packets(spark, new_dir + "/in")
    got, state = run_to_end(sf.stream_flows(sf.stream_packets(spark, new_dir + "/in", 1)), new_dir, spark)
    want = fl.assemble_flows(packets, "live").select(*got.columns)
    show = lambda d: sorted(tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in d.collect())
    assert show(got) == show(want)
    assert max(state) > 0 and state[-1] == 0  # nothing is left behind


def test_late_rows_of_one_key_are_taken_in_order(spark, new_dir, make_packets):
    """A FIN that arrives before the packet sent ahead of it still ends one flow of both."""
    ip = ("10.0.0.1", 1000, "10.0.0.2", 80)
    t = 10**15
    rows = [(1, t, *ip, 2), (3, t + 3_000_000, *ip, 4), (2, t + 1_000_000, *ip, 24, 50), (4, t + 400_000_000, *ip, 2)]
    for r in rows:
        make_packets([r]).coalesce(1).write.mode("append").parquet(new_dir + "/in")
    sf.close_packets(spark, new_dir + "/in")
    got, state = run_to_end(sf.stream_flows(sf.stream_packets(spark, new_dir + "/in", 1)), new_dir, spark)
    assert sorted((r.start_us, r.packet_count, r.close_reason) for r in got.collect()) == [(t, 3, "rst"), (t + 400_000_000, 1, "timeout")]
    assert state[-1] == 0


def test_state_of_silent_keys_expires(spark, new_dir):
    """Without an end of the input, only what the watermark has not passed is left."""
    log = views.attack_log_v(spark, SF).filter("is_attack = 1")
    last = log.agg(F.max("timestamp_utc")).first()[0]
    late = log.limit(1).withColumn("timestamp_utc", F.lit(last + 10_000_000).cast("long")).withColumn("src_ip", F.lit("far"))
    log.coalesce(1).write.parquet(new_dir + "/log")
    late.coalesce(1).write.mode("append").parquet(new_dir + "/log")
    stream = sd.stream_throttle(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(new_dir + "/log"), 300, "src_ip")
    got, state = run_to_end(stream, new_dir, spark)
    assert state[-1] <= 4  # the far key's row, memory and timer
    want = se.throttle_alerts(log, 300, "src_ip")
    assert sorted(r.id for r in got.filter("src_ip <> 'far'").collect()) == sorted(r.id for r in want.collect())


def test_stream_detect_writes_the_log_once(spark, new_dir):
    from flowloom.plans.flow_queries import mixed_flows
    flows = mixed_flows(spark, SF, "live")
    flows.write.parquet(new_dir + "/flows")
    flows = spark.read.parquet(new_dir + "/flows")
    close_input(spark, new_dir + "/flows", flows.schema, "end_us")
    flows = flows.filter("src_ip is not null")
    source = spark.readStream.schema(flows.schema).parquet(new_dir + "/flows")
    for _ in range(2):
        sd.stream_detect(source, new_dir + "/log", new_dir + "/cp").awaitTermination(300)
    log = read_log(spark, new_dir + "/log")
    assert log.count() == flows.count()
    batch = ru.run_detection(flows)
    count = lambda d, c: {r[0]: r[1] for r in d.groupBy(c).count().collect()}
    assert count(log, "attack_type") == count(batch, "label")


def test_stream_port_scan_equals_batch(spark, new_dir):
    flows = views.scan_flows_v(spark, SF)
    stream = shuffled(spark, flows, "end_us", 100_000_000, new_dir + "/flows")
    close_input(spark, new_dir + "/flows", flows.schema, "end_us")
    got, state = run_to_end(sd.mark_port_scans(stream), new_dir, spark)
    want = ru.port_scan_alerts(ru.port_scan_probes(flows))
    show = lambda d: sorted((r.src_ip, r.end_us, r.dst_port, r.ports) for r in d.collect())
    assert show(got.filter("ports is not null")) == show(want) and got.count() == flows.count()
    assert state[-1] == 0


def test_stream_series_and_throttle(spark, new_dir):
    log = views.attack_log_v(spark, SF)
    log.write.parquet(new_dir + "/log")
    source = lambda: spark.readStream.schema(log.schema).parquet(new_dir + "/log")
    stream = shuffled(spark, log, "timestamp_utc", 500, new_dir + "/late")
    close_input(spark, new_dir + "/late", log.schema, "timestamp_utc", 1_000_000)
    sent, state = run_to_end(sd.stream_throttle(stream, fv.MAIL_COOLDOWN_S), new_dir + "/a", spark)
    want = se.throttle_alerts(log, fv.MAIL_COOLDOWN_S)
    assert sorted(r.id for r in sent.collect()) == sorted(r.id for r in want.collect())
    assert state[-1] == 0
    one = run(sd.stream_dedup_alerts(source().union(source())), new_dir + "/b", spark)
    assert one.count() == se.dedup_alerts(log).count()
    seen = []
    sd.stream_feed(source(), lambda rows: seen.extend(r.id for r in rows.collect()), new_dir + "/c").awaitTermination(120)
    assert len(seen) == 50


class _State(dict):
    """Stands for a key's map state and value state."""

    row = None
    updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.__delitem__

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None


def test_waiting_rows_are_merged_from_runs_a_block_at_a_time(monkeypatch):
    """Rows of a key are handed over one by one and in order; only a block of each run has been read by then."""
    from types import SimpleNamespace

    import pandas as pd

    from flowloom.streaming import ordered

    monkeypatch.setattr(ordered, "RUN_ROWS", 100)
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 10)
    left, taken = [], []

    def step(key, memory, rows, mark):
        for r in rows:
            left.append(len(state))
            taken.append((r.at, r.id))
            yield (r.id,)
        return None, None

    p = ordered._InOrder(["at", "id", "key", "_at"], [0, 1], ["key"], ["id"], step, ["id"])
    state, info = _State(), _State()
    p.handle, p.blocks, p.info = SimpleNamespace(registerTimer=lambda t: None, deleteTimer=lambda t: None), state, info
    times = [(i * 7919) % 1000 for i in range(1000)]
    data = pd.DataFrame({"c0": times, "c1": range(1000), "c2": "k", "c3": times, "missing0": [2 if t == 5 else 0 for t in times]})
    assert list(p.handleInputRows(None, iter([data[:450], data[450:]]), None)) == [] and len(state) == 100
    at = lambda us: SimpleNamespace(getCurrentWatermarkInMs=lambda: us / 1000)
    first = [i for pdf in p.handleExpiredTimer(None, at(499), None) for i in pdf["id"].tolist()]
    assert len(first) == 500 and first[5] is None and left[0] == 100 and left[250] > 70
    second = [i for pdf in p.handleExpiredTimer(None, at(1000), None) for i in pdf["id"].tolist()]
    assert [t for t, _ in taken] == list(range(1000)) and len(second) == 500
    assert not state and not info.exists()
