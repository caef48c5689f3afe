"""Queries over the prediction log: history, totals, distribution, top lists, threat level, reports."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowloom import fixed_values as fv

LOG_COLUMNS = ("id", "attack_type", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "confidence",
               "is_attack", "flow_id", "timestamp_utc")


def _is_attack() -> Column:
    return F.col("is_attack") == 1


def to_attack_log(predicted: DataFrame) -> DataFrame:
    """Prediction rows (with a ``context`` struct) to log rows; a missing context gives empty values."""
    ctx = lambda name, empty: F.coalesce(F.col(f"context.{name}"), F.lit(empty))
    return predicted.select(
        F.col("label").alias("attack_type"), ctx("src_ip", "").alias("src_ip"), ctx("dst_ip", "").alias("dst_ip"),
        ctx("src_port", 0).alias("src_port"), ctx("dst_port", 0).alias("dst_port"),
        ctx("protocol", 0).alias("protocol"), "confidence", F.col("is_attack").cast("int").alias("is_attack"),
        ctx("flow_id", "").alias("flow_id"), "timestamp_utc")


def _page_filter(attack_type: str | None, only_attacks: bool) -> Column:
    if attack_type and attack_type != "All":
        return F.col("attack_type") == attack_type
    return _is_attack() if only_attacks else F.lit(True)


def _newest_days(rows: DataFrame, n: int) -> DataFrame:
    """*rows* without the days that the *n* newest can't be in, where the log has a ``day`` to prune by.

    Rows are counted per day, which reads no column but those filtered by; one
    more day stays, for writers in other time zones.
    """
    if dict(rows.dtypes).get("day") != "date":
        return rows
    found = 0
    for day, count in rows.groupBy("day").count().filter("day is not null").orderBy(F.desc("day")).toLocalIterator():  # a row per day
        found += count
        if found >= n:
            return rows.filter(F.col("day") >= F.lit(day - timedelta(days=1)))
    return rows


def attack_history(log: DataFrame, limit: int = 50, offset: int = 0, attack_type: str | None = None, only_attacks: bool = False) -> DataFrame:
    """One page of the log, newest first (ties by id)."""
    page = _newest_days(log.filter(_page_filter(attack_type, only_attacks)), offset + limit)
    return page.orderBy(F.desc("timestamp_utc"), F.desc("id")).offset(offset).limit(limit)


def attack_history_total(log: DataFrame, page_size: int = 50, attack_type: str | None = None, only_attacks: bool = False) -> DataFrame:
    """Rows matching the page filter and the number of pages."""
    return log.filter(_page_filter(attack_type, only_attacks)).agg(
        F.count("*").alias("total"), F.ceil(F.count("*") / page_size).cast("long").alias("pages"))


def log_stats(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("total"), F.count_if(F.col("is_attack") == 0).alias("normal"),
        F.count_if(_is_attack()).alias("attacks"))


def attack_distribution(log: DataFrame) -> DataFrame:
    counts = log.filter(_is_attack()).groupBy("attack_type").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "attack_type")


def _with_share(counts: DataFrame, digits: int, name: str) -> DataFrame:
    # one row per attack class, so a global window is fine
    total = F.sum("count").over(W.partitionBy(F.lit(1)))
    return counts.withColumn(name, F.round(F.col("count") / total * 100, digits))


def attack_summary(log: DataFrame) -> DataFrame:
    """Attack types with count and percentage of all attacks (2 decimals)."""
    counts = log.filter(_is_attack()).groupBy("attack_type").agg(F.count("*").alias("count"))
    return _with_share(counts, 2, "percentage").orderBy(F.desc("count"), "attack_type")


def attack_share(log: DataFrame) -> DataFrame:
    """Attack types with share of all attacks as text, one decimal."""
    counts = log.filter(_is_attack()).groupBy("attack_type").agg(F.count("*").alias("count"))
    shares = _with_share(counts, 1, "share").withColumn("share", F.format_string("%.1f%%", "share"))
    return shares.orderBy(F.desc("count"), "attack_type")


def top_attackers(log: DataFrame, n: int = 10) -> DataFrame:
    counts = log.filter(_is_attack()).groupBy("src_ip").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "src_ip").limit(n)


def report_top_attackers(log: DataFrame, n: int = 10) -> DataFrame:
    """The top list with ranks 1..n (ranked after the top-k, on n rows)."""
    rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("count"), "src_ip"))
    return top_attackers(log, n).withColumn("rank", rank.cast("long"))


def recent(log: DataFrame, n: int = 10, only_attacks: bool = False) -> DataFrame:
    rows = log.filter(_is_attack()) if only_attacks else log
    return _newest_days(rows, n).orderBy(F.desc("timestamp_utc"), F.desc("id")).limit(n)


def feed(log: DataFrame, n: int = 50) -> DataFrame:
    """The newest *n* rows in the shape of a live feed."""
    return recent(log, n).select("id", "timestamp_utc", "attack_type", "is_attack", "flow_id")


def recent_attacks(log: DataFrame, n: int = 100) -> DataFrame:
    return recent(log, n, only_attacks=True)


def level_of(count: Column) -> Column:
    return (F.when(count >= fv.CRITICAL_ATTACKS, "CRITICAL")
            .when(count >= fv.ELEVATED_ATTACKS, "ELEVATED").otherwise("SAFE"))


def as_of_or_latest(log: DataFrame, as_of: float | None) -> float | None:
    """The evaluation time: *as_of*, else the latest log time (one scalar, so that it reaches the scan as a literal)."""
    return as_of if as_of is not None else _newest_days(log, 1).agg(F.max("timestamp_utc")).first()[0]


def _in_window(now: float | None, seconds: int = fv.THREAT_WINDOW_S) -> Column:
    if now is None:
        return F.lit(False)
    return _is_attack() & (F.col("timestamp_utc") >= now - seconds)


def _days_of_window(log: DataFrame, now: float | None, seconds: int = fv.THREAT_WINDOW_S) -> DataFrame:
    """*log* from the day before the window's on, where it has a ``day``; the day more is for writers in other time zones."""
    if now is None or dict(log.dtypes).get("day") != "date":
        return log
    return log.filter(F.col("day") >= F.lit(datetime.fromtimestamp(now - seconds, timezone.utc).date() - timedelta(days=1)))


def threat_level(log: DataFrame, as_of: float | None = None) -> DataFrame:
    """Attacks in the last 60 s before *as_of* (default: the latest log time) and the level."""
    now = as_of_or_latest(log, as_of)
    row = _days_of_window(log, now).filter(_in_window(now)).agg(F.count("*").alias("attacks_60s"))
    return row.withColumn("threat_level", level_of(F.col("attacks_60s")))


def threat_level_series(log: DataFrame, keys: tuple[str, ...] = (), slot_s: int = 3600) -> DataFrame:
    """The threat level at every time an attack happened (optionally per key).

    Attacks are first counted per distinct time; each time slot also gets the
    last 60 s of the slot before, so slots are computed independently.
    """
    t, span = F.col("timestamp_utc"), fv.THREAT_WINDOW_S
    per_time = log.filter(_is_attack()).groupBy(*keys, "timestamp_utc").agg(F.count("*").alias("attacks"))
    if slot_s < span:
        raise ValueError(f"slot_s must be at least the window of {span} s")
    slot = F.floor(t / slot_s)
    late = F.floor((t + span) / slot_s) > slot
    rows = per_time.withColumn("_slot", F.explode(F.when(late, F.array(slot, slot + 1)).otherwise(F.array(slot))))
    w = W.partitionBy(*keys, "_slot").orderBy("timestamp_utc").rangeBetween(-span, 0)
    counted = rows.withColumn("attacks_60s", F.sum("attacks").over(w)).filter(F.col("_slot") == F.floor(t / slot_s))
    return counted.withColumn("threat_level", level_of(F.col("attacks_60s"))).drop("_slot")


def _one_row_status(log: DataFrame, as_of: float | None) -> DataFrame:
    now = as_of_or_latest(log, as_of)
    return log.agg(
        F.count("*").alias("total_packets"), F.count_if(_is_attack()).alias("attack_count"),
        F.count_if(F.col("is_attack") == 0).alias("normal_count"), F.count_if(_in_window(now)).alias("attacks_60s"))


def dashboard_status(log: DataFrame, as_of: float | None = None, started_at: float | None = None, model_version: str = "") -> DataFrame:
    """Status row: threat level, counters, top attacker and attack types, from one pass plus two top lists."""
    status = _one_row_status(log, as_of).withColumn("threat_level", level_of(F.col("attacks_60s"))).drop("attacks_60s")
    if as_of is not None and started_at is not None:
        status = status.withColumn("uptime_seconds", F.lit(round(as_of - started_at, 2)))
    status = status.withColumn("model_version", F.lit(model_version)) if model_version else status
    top = top_attackers(log, 1).agg(F.first("src_ip").alias("top_attacker"), F.first("count").alias("top_attacker_count"))
    types = attack_distribution(log).agg(F.count("*").alias("attack_types"))
    return _side_by_side(status, top, types)


def _side_by_side(*one_row: DataFrame) -> DataFrame:
    """Put one-row results next to each other."""
    out = one_row[0].withColumn("_one", F.lit(1))
    for d in one_row[1:]:
        out = out.join(d.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def report_summary(log: DataFrame, as_of: float | None = None) -> DataFrame:
    """Executive summary row with the attack percentage."""
    row = _one_row_status(log, as_of)
    share = F.when(F.col("total_packets") > 0, F.col("attack_count") / F.col("total_packets") * 100).otherwise(0.0)
    return row.select(
        "total_packets", "normal_count", "attack_count", F.round(share, 2).alias("attack_percentage"),
        level_of(F.col("attacks_60s")).alias("threat_level"))


def report_recommendations(log: DataFrame, as_of: float | None = None) -> DataFrame:
    """Numbered advice for the threat level and the attack types present, always closed by one line."""
    spark = log.sparkSession
    level_rows = spark.createDataFrame([(i, *r) for i, r in enumerate(fv.LEVEL_ADVICE)], "pos int, threat_level string, advice string")
    type_rows = spark.createDataFrame([(100 + i, *r) for i, r in enumerate(fv.TYPE_ADVICE)], "pos int, attack_type string, advice string")
    level = threat_level(log, as_of)
    present = log.filter(_is_attack()).groupBy("attack_type").count()
    by_level = level_rows.join(level, "threat_level", "left_semi").select("pos", "advice")
    by_type = type_rows.join(present, "attack_type", "left_semi").select("pos", "advice")
    found = by_level.unionByName(by_type)
    calm = found.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit(1000).alias("pos"), F.lit(fv.CALM_ADVICE).alias("advice"))
    closing = spark.range(1).select(F.lit(1001).alias("pos"), F.lit(fv.CLOSING_ADVICE).alias("advice"))
    lines = found.unionByName(calm).unionByName(closing)
    number = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("pos"))  # at most a dozen lines
    return lines.select(number.cast("long").alias("line"), "advice")


def latest_agent_status(events: DataFrame, key: str = "agent", status: str = "status", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Latest status per agent; a disconnect reads OFFLINE."""
    latest = events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.max(order[0]).alias("last_seen"))
    return latest.withColumn("status", F.when(F.col("status") == "disconnect", "OFFLINE").otherwise(F.col("status")))


def security_context(log: DataFrame, as_of: float | None = None, recent_n: int = 5, top_n: int = 5) -> DataFrame:
    """One row describing the situation: level, totals, and text lists of types, recent rows and top sources."""
    status = _one_row_status(log, as_of).withColumn("threat_level", level_of(F.col("attacks_60s"))).drop("attacks_60s")

    def text(rows: DataFrame, order: list[Column], line: Column, name: str) -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct(F.col("_pos"), line.alias("line"))))
        numbered = rows.withColumn("_pos", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))  # top-k rows only
        joined = F.concat_ws("\n", F.transform(packed, lambda s: s["line"]))
        return numbered.agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit("  None")).alias(name))

    newest = [F.desc("timestamp_utc"), F.desc("id")]
    return _side_by_side(
        status,
        text(attack_summary(log), [F.desc("count"), F.asc("attack_type")],
             F.format_string("  - %s: %d (%.1f%%)", "attack_type", "count", "percentage"), "attack_summary"),
        text(recent(log, recent_n), newest, F.format_string("  - %s from %s", "attack_type", "src_ip"), "recent_attacks"),
        text(top_attackers(log, top_n), [F.desc("count"), F.asc("src_ip")],
             F.format_string("  - %s (%d attacks)", "src_ip", "count"), "top_attackers"))


def sort_history(df: DataFrame, key: str, direction: str = "desc") -> DataFrame:
    """Sort by any column, text without regard to case (ties by id)."""
    is_text = dict(df.dtypes)[key] == "string"
    c = F.lower(key) if is_text else F.col(key)
    return df.orderBy(c.asc() if direction == "asc" else c.desc(), *(["id"] if "id" in df.columns else []))


def normalize_alerts(df: DataFrame) -> DataFrame:
    """Alert rows of mixed shape: type from attack_type, label or BENIGN; endpoints from the row or its context."""
    names = set(df.columns)
    col = lambda c, t: F.col(c) if c in names else F.lit(None).cast(t)
    ctx = lambda c, t: F.col(f"context.{c}") if "context" in names else F.lit(None).cast(t)
    text = lambda c: F.nullif(c, F.lit(""))
    return df.withColumns({
        "attack_type": F.coalesce(text(col("attack_type", "string")), text(col("label", "string")), F.lit("BENIGN")),
        **{c: F.coalesce(text(col(c, "string")), text(ctx(c, "string")), F.lit("")) for c in ("src_ip", "dst_ip")},
        **{c: F.coalesce(col(c, "int"), ctx(c, "int"), F.lit(0)) for c in ("src_port", "dst_port", "protocol")}})
