"""Streaming detection, port-scan alerts, alert throttle, and streaming forms of the log series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from flowloom import fixed_values as fv
from flowloom.operators import rules as ru
from flowloom.operators.flows import with_flow_context
from flowloom.operators.log import recent, to_attack_log
from flowloom.operators.series import throttle_step
from flowloom.sources.sinks import log_sink
from flowloom.streaming.ordered import END_US, in_event_order


#: How much later than its end a flow may arrive: a silent one is only known to have ended after its limit.
FLOWS_LATE = "150 seconds"


def mark_port_scans(
    flows: DataFrame, window_us: int = fv.SCAN_WINDOW_US, min_ports: int = fv.SCAN_MIN_PORTS, cooldown_us: int = fv.SCAN_COOLDOWN_US, late: str = FLOWS_LATE,
) -> DataFrame:
    """All flows of a stream with ``ports`` set where a port-scan alert is raised.

    Only probes reach the stateful operator, which takes them in order of their
    end (ties by port and flow id), however they arrive within *late*; other flows
    pass by.  State per source: the probes that wait, fewer than *min_ports* ports,
    and the last alert.  It goes when window and cool-down have passed.
    """
    cols = flows.columns
    keeps = max(window_us, cooldown_us)

    def step(key, memory, rows, mark):
        memory = memory or {}
        for r in rows:
            yield (*r[:len(cols)], ru.scan_step(memory, r.end_us, r.dst_port, window_us, min_ports, cooldown_us))
        latest = max([*memory.get("ports", {}).values(), memory.get("alert") or 0], default=0)
        # beyond this time no probe in the window and no cool-down is left, as in an empty memory
        return (memory if memory and latest + keeps >= mark else None), latest + keeps

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in flows.schema.fields], T.StructField("ports", T.LongType())])
    order = ["dst_port", *[c for c in ru.FLOW_ID if c in cols]]
    probes = in_event_order(flows, ["src_ip"], F.col("end_us"), order, step, schema, late, ru.is_probe())
    others = flows.filter(~F.coalesce(ru.is_probe(), F.lit(False)) & F.coalesce(F.col("end_us") < END_US, F.lit(True))).withColumn("ports", F.lit(None).cast("long"))
    return probes.unionByName(others)


def stream_port_scan(flows: DataFrame) -> DataFrame:
    """Port-scan alerts of a flow stream."""
    return mark_port_scans(flows).filter("ports is not null")


def stream_detect(flows: DataFrame, log_path: str, checkpoint: str, score: Callable[[DataFrame], DataFrame] | None = None,
                  threshold: float = fv.ATTACK_THRESHOLD, **trigger) -> StreamingQuery:
    """Flow stream -> filter, model, rules -> prediction log, once per batch.

    Start it on a table that ``stream_flows`` writes: two queries with their
    own checkpoints, so either can be stopped and started again alone; a batch
    that was cut off is written again in place of its first try.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        checked = ru.traffic_filter(batch)
        if score is None:
            predicted = checked.withColumns(ru.benign_result(F.col("bypass_reason")))
        else:
            benign = checked.filter("bypass_reason is not null").withColumns(ru.benign_result(F.col("bypass_reason")))
            predicted = benign.unionByName(score(checked.filter("bypass_reason is null")).select(*benign.columns))
        decided = ru._decide(predicted, threshold, F.col("ports")).withColumn("timestamp_utc", F.col("end_us") / 1e6)
        log_sink(log_path, checkpoint)(to_attack_log(with_flow_context(decided)), batch_id)

    return mark_port_scans(flows).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def stream_throttle(alerts: DataFrame, cooldown_s: float = fv.CHAT_COOLDOWN_S, key: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Attack alerts let through, at most one per cool-down and key, in order of time and id however they arrive within *late*.

    State per key: the alerts that wait and the time of the last one sent, which goes when its cool-down has passed.
    """
    cols = alerts.columns

    def step(_, memory, rows, mark):
        last = memory and memory["last"]
        for r in rows:
            if throttle_step(last, float(r.timestamp_utc), cooldown_s):
                yield tuple(r[:len(cols)])
                last = float(r.timestamp_utc)
        ends = None if last is None else int((last + cooldown_s) * 1e6)
        return (None if last is None or ends < mark else {"last": last}), ends

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in alerts.schema.fields])
    at = F.floor(F.col("timestamp_utc").cast("double") * 1_000_000).cast("long")
    channel = F.col(key).cast("string") if key else F.lit("all")
    return in_event_order(alerts.withColumn("_channel", channel), ["_channel"], at, ["id"], step, schema, late, F.col("is_attack") == 1)


def stream_dedup_alerts(alerts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One attack alert per (time, flow) within the watermark."""
    timed = alerts.filter("is_attack = 1").withColumn("event_time", F.timestamp_seconds("timestamp_utc"))
    return timed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["timestamp_utc", "flow_id"])


def stream_traffic_stats(log: DataFrame, late: str = "1 minute", width: str = "1 minute") -> DataFrame:
    """Totals per time window of a log stream (``width="1 second"`` for the live chart)."""
    timed = log.withColumn("event_time", F.timestamp_seconds("timestamp_utc")).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", width)).agg(
        F.count("*").alias("total"), F.count_if(F.col("is_attack") == 0).alias("normal"),
        F.count_if(F.col("is_attack") == 1).alias("attack")).select(
        F.unix_seconds("window.start").alias("start_utc"), "total", "normal", "attack")


def stream_counts(log: DataFrame) -> DataFrame:
    """Counters since the start (use output mode ``complete``)."""
    return log.groupBy().agg(
        F.count("*").alias("total"), F.count_if(F.col("is_attack") == 0).alias("normal"),
        F.count_if(F.col("is_attack") == 1).alias("attack"))


def stream_feed(log: DataFrame, show: Callable[[DataFrame], None], checkpoint: str, n: int = 50, **trigger) -> StreamingQuery:
    """Hand the newest *n* rows of every batch to *show*."""
    return log.writeStream.foreachBatch(lambda batch, _: show(recent(batch, n))).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
