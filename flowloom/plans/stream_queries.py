"""Streaming operators run to the end of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import fixed_values as fv
from flowloom.operators import packets as pk
from flowloom.operators.session import cut, shared_dir
from flowloom.plans import view_sql as vs
from flowloom.plans import views
from flowloom.plans.log_queries import _DENSE, _THROTTLE
from flowloom.plans.registry import query, rounded
from flowloom.plans.flow_queries import mixed_flows
from flowloom.plans.rule_queries import ALERTS, RUN_DETECTION
from flowloom.sources.sinks import ATTACK_LOG, read_log
from flowloom.streaming import detect as sd
from flowloom.streaming import flows as sf
from flowloom.streaming.ordered import close_input


def _finish(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Write the stream until its input is used up, then read what it wrote."""
    path = _folder(spark)
    q = (stream.writeStream.format("parquet").option("path", path + "/out").option("checkpointLocation", path + "/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + "/out")


def _arrivals(spark: SparkSession, rows: DataFrame, at_us, late_us: int, files: int, path: str, first: int = 0, last: int | None = None) -> None:
    """Write *rows* as files in the order of their arrival, which is up to *late_us* after their time, by hash: inside and across files times are out of order.

    ``first`` and ``last`` choose some of the files.
    """
    # the rows are derived once, not again for their bounds and for every file
    rows = cut(rows.withColumn("_arrives", at_us + F.pmod(F.xxhash64(*rows.columns), F.lit(late_us))))
    edges = rows.select(F.min("_arrives"), F.max("_arrives")).first()
    if edges[0] is None:
        return
    width = (edges[1] - edges[0]) // files + 1
    numbered = rows.withColumn("_file", F.floor((F.col("_arrives") - F.lit(edges[0])) / width)).drop("_arrives")
    for k in range(first, files if last is None else last):
        numbered.filter(F.col("_file") == k).drop("_file").repartition(1, F.rand(7)).write.mode("append").parquet(path)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


_fid = vs.KEY


@query(f"""with {vs.PACKETS}, {vs.flows('packets_v', 'live')}
  select {_fid}, start_us, end_us, packet_count, close_reason, {", ".join(f"round({c}, 3) + 0.0 as {c}" for c in fv.FEATURE_COLUMNS)} from flows""")
def stream_flows(spark, sf_dir):
    """All flows of a packet stream whose packets arrive out of order, up to its end."""
    path = _folder(spark)
    packets = views.packets_v(spark, sf_dir).withColumn("ip_total_length", F.lit(0)).select(*[F.col(f.name).cast(f.dataType) for f in pk.PACKETS.fields])
    _arrivals(spark, packets, F.col("timestamp_us"), 9_000_000, 3, path)
    sf.close_packets(spark, path)
    return rounded(_finish(spark, sf.stream_flows(sf.stream_packets(spark, path, 1))).select(
        *pk.KEY, "start_us", "end_us", "packet_count", "close_reason", *fv.FEATURE_COLUMNS), 3)


@query(ALERTS)
def stream_port_scan(spark, sf_dir):
    """Port-scan alerts of flows that arrive out of order."""
    flows, path = views.scan_flows_v(spark, sf_dir), _folder(spark)
    _arrivals(spark, flows, F.col("end_us"), 100_000_000, 3, path)
    close_input(spark, path, flows.schema, "end_us")
    stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _finish(spark, sd.stream_port_scan(stream)).select("src_ip", "dst_port", "end_us", "flow_no", "ports")


@query(RUN_DETECTION)
def stream_detect(spark, sf_dir):
    """The whole cascade from a flow stream down to log rows; the query is stopped after half of the input and started again from its checkpoint."""
    path = _folder(spark)
    mixed_flows(spark, sf_dir, "live").write.parquet(path + "/all")
    flows = spark.read.parquet(path + "/all")
    source = lambda: spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(path + "/flows")
    run = lambda: sd.stream_detect(source(), path + "/log", path + "/state").awaitTermination()
    _arrivals(spark, flows, F.col("end_us"), 100_000_000, 4, path + "/flows", 0, 2)
    run()
    _arrivals(spark, flows, F.col("end_us"), 100_000_000, 4, path + "/flows", 2)
    close_input(spark, path + "/flows", flows.schema, "end_us")
    run()
    columns = [c.name for c in ATTACK_LOG.fields[1:11]]
    return rounded(read_log(spark, path + "/log").select(*columns))


def _dense_stream(spark, sf_dir, stream=True):
    return views.attack_log_v(spark, sf_dir, stream=stream).withColumn("timestamp_utc", F.floor(F.col("timestamp_utc") / 100).cast("long"))


@query(_THROTTLE)
def stream_throttle(spark, sf_dir):
    """Alerts let through, of alerts that arrive out of order."""
    log, path = _dense_stream(spark, sf_dir, stream=False), _folder(spark)
    _arrivals(spark, log, F.col("timestamp_utc") * 1_000_000, 500_000_000, 3, path)
    close_input(spark, path, log.schema, "timestamp_utc", 1_000_000)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _finish(spark, sd.stream_throttle(stream, fv.MAIL_COOLDOWN_S)).select("id", "timestamp_utc")


@query(f"""with {_DENSE}, m as (select max(timestamp_utc) - 60 as mark from dense),
  w as (select cast(floor(timestamp_utc / 60) * 60 as bigint) as start_utc, count(*) as total, count(*) filter (is_attack = 0) as normal,
    count(*) filter (is_attack = 1) as attack from dense group by 1) select w.* from w, m where start_utc + 60 <= mark""")
def stream_traffic_stats(spark, sf_dir):
    """Minutes that were complete before the watermark."""
    return _finish(spark, sd.stream_traffic_stats(_dense_stream(spark, sf_dir)))


@query(f"with {_DENSE} select distinct timestamp_utc, flow_id from dense where is_attack = 1")
def stream_dedup_alerts(spark, sf_dir):
    return _finish(spark, sd.stream_dedup_alerts(_dense_stream(spark, sf_dir)).select("timestamp_utc", "flow_id"))
