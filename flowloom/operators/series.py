"""Time series and alerts over the prediction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowloom import fixed_values as fv
from flowloom.operators.log import as_of_or_latest
from flowloom.operators.running import cooldown_fires

_attacks = lambda: F.count_if(F.col("is_attack") == 1)
_normal = lambda: F.count_if(F.col("is_attack") == 0)


def traffic_series(log: DataFrame, as_of: int | None = None, seconds: int = 60) -> DataFrame:
    """Normal and attack rows per second for the last *seconds* up to *as_of*, empty seconds included."""
    t = F.floor("timestamp_utc").cast("long")
    latest = as_of_or_latest(log, as_of)
    if latest is None:
        return log.limit(0).select(t.alias("time"), F.lit(0).cast("long").alias("normal"), F.lit(0).cast("long").alias("attack"))
    now = int(latest // 1)
    axis = log.sparkSession.range(now - seconds + 1, now + 1).select(F.col("id").alias("time"))
    recent = log.filter((F.col("timestamp_utc") >= now - seconds + 1) & (F.col("timestamp_utc") < now + 1))
    counts = recent.groupBy(t.alias("time")).agg(_normal().alias("normal"), _attacks().alias("attack"))
    return axis.join(counts, "time", "left").fillna(0, ["normal", "attack"])


def traffic_stats(log: DataFrame, minutes: int = 1) -> DataFrame:
    """Total, normal and attack rows per minute that has any."""
    width = 60 * minutes
    minute = (F.floor(F.col("timestamp_utc") / width) * width).cast("long")
    return log.groupBy(minute.alias("minute_utc")).agg(
        F.count("*").alias("total"), _normal().alias("normal"), _attacks().alias("attack"))


def running_counts(log: DataFrame, slot_s: int = 3600) -> DataFrame:
    """Counters since the start after every distinct log time.

    Rows collapse to one per time first; slots are summed on their own and
    get the totals of all earlier slots (one small row per slot).
    """
    t = F.col("timestamp_utc")
    names = ("total", "normal", "attack")
    per_time = log.groupBy("timestamp_utc").agg(
        F.count("*").alias("total"), _normal().alias("normal"), _attacks().alias("attack")
    ).withColumn("_slot", F.floor(t / slot_s))
    earlier = W.partitionBy(F.lit(1)).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_time.groupBy("_slot").agg(*[F.sum(n).alias(n) for n in names]).select(
        "_slot", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_o_{n}") for n in names])
    inside = W.partitionBy("_slot").orderBy("timestamp_utc").rowsBetween(W.unboundedPreceding, 0)
    local = per_time.select("timestamp_utc", "_slot", *[F.sum(n).over(inside).alias(n) for n in names])
    return local.join(offsets, "_slot").select(
        "timestamp_utc", *[(F.col(n) + F.col(f"_o_{n}")).alias(n) for n in names])


def dedup_alerts(alerts: DataFrame, order: str = "id") -> DataFrame:
    """One attack alert per (time, flow): the first by *order*."""
    rows = alerts.filter(F.col("is_attack") == 1)
    others = [c for c in rows.columns if c not in ("timestamp_utc", "flow_id")]
    first = F.min_by(F.struct(*others), order).alias("_first")
    return rows.groupBy("timestamp_utc", "flow_id").agg(first).select("timestamp_utc", "flow_id", "_first.*")


def throttle_step(last: float | None, now: float, cooldown_s: float) -> bool:
    """Whether an alert at *now* is sent, given the time of the last one sent."""
    return last is None or now - last >= cooldown_s


def throttle_alerts(alerts: DataFrame, cooldown_s: float = fv.CHAT_COOLDOWN_S, key: str | None = None) -> DataFrame:
    """Alerts that are sent: attacks only, at most one per cool-down and key, first one wins.

    Which alert is sent depends on the one sent before, so this is a fold, but
    only over the distinct attack times of a key (alerts at one time count once,
    the smallest id of it is sent), in slots of time side by side.
    """
    rows = alerts.filter(F.col("is_attack") == 1).withColumn("_key", F.col(key).cast("string") if key else F.lit("all"))
    times = rows.groupBy("_key", F.col("timestamp_utc").cast("double").alias("at")).agg(F.min("id").alias("id"))

    def every(pdf, first):
        import numpy as np

        return np.maximum(np.arange(len(pdf) + 1), first)

    sent = cooldown_fires(times, ["_key"], "at", [], cooldown_s, 0, every)
    return rows.join(sent.select("_key", "id"), ["_key", "id"], "left_semi").drop("_key")


def alert_messages(log: DataFrame, subject_prefix: str = "[Alert]") -> DataFrame:
    """Chat, mail-subject, mail-detail and spoken text of every attack."""
    or_unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    at = F.date_format(F.timestamp_seconds("timestamp_utc"), "yyyy-MM-dd HH:mm:ss")
    share = F.format_string("%.2f%%", F.col("confidence") * 100)
    src, dst = or_unknown("src_ip"), or_unknown("dst_ip")
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    port = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    chat = line(
        "<b>⚠️ Attack Detected</b>\n<b>Type:</b> ", F.col("attack_type"), "\n<b>Confidence:</b> ", share,
        "\n<b>Source:</b> ", src, ":", port("src_port"), "\n<b>Destination:</b> ", dst, ":", port("dst_port"),
        "\n<b>Time (UTC):</b> ", at)
    return log.filter(F.col("is_attack") == 1).select(
        "id", chat.alias("chat_text"),
        line(subject_prefix, " ", F.col("attack_type"), " Attack Detected").alias("mail_subject"),
        line("Attack Type: ", F.col("attack_type"), "; Confidence: ", share, "; Source IP: ", src, ":", port("src_port"),
             "; Destination IP: ", dst, ":", port("dst_port"), "; Time (UTC): ", at, " UTC").alias("mail_details"),
        line("Warning! ", F.col("attack_type"), " detected from IP ", src).alias("spoken_text"))
