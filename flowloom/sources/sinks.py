"""Writers: cleaned tables, splits, audits, the prediction log and its exports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from flowloom import fixed_values as fv
from flowloom.functions import scalar as sc
from flowloom.sources import compaction

ATTACK_LOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("is_attack", T.IntegerType()),
    T.StructField("flow_id", T.StringType()),
    T.StructField("timestamp_utc", T.DoubleType()),
    T.StructField("day", T.DateType()),
    T.StructField("query_id", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])


def write_cleaned(df: DataFrame, path: str) -> None:
    """Features in order, then provenance and label; Parquet with zstd."""
    tail = [*fv.PROVENANCE, fv.TARGET]
    ordered = [c for c in df.columns if c not in tail] + tail
    df.select(*ordered).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    """Train and test rows (vector, provenance, label), one folder per ``part``."""
    df.write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(path)


def write_audit(df: DataFrame, path: str) -> None:
    """A one-row audit as JSON; the committer replaces the old one only when the new one is complete."""
    df.coalesce(1).write.mode("overwrite").json(path)


def log_rows(rows: DataFrame, batch_id: int, query_id: str) -> DataFrame:
    """Log rows with a day partition, the query and batch that wrote them, and an id of their own that is the same on every retry."""
    columns = [c.name for c in ATTACK_LOG.fields[1:11]]
    copy = F.row_number().over(W.partitionBy(*columns).orderBy(F.lit(0)))  # tells equal rows of a batch apart
    key = F.concat_ws("|", F.lit(query_id), F.lit(str(batch_id)), "flow_id", F.col("timestamp_utc").cast("string"), F.xxhash64(*columns).cast("string"), copy.cast("string"))
    return rows.select(
        F.sha2(key, 256).alias("id"), *columns, F.to_date(F.timestamp_seconds("timestamp_utc")).alias("day"),
        F.lit(query_id).alias("query_id"), F.lit(batch_id).cast("long").alias("batch_id"))


def append_predictions(rows: DataFrame, path: str, batch_id: int, query_id: str) -> None:
    """Write one batch of log rows; a repeated batch replaces itself, so a retry adds nothing twice.

    The log is partitioned by day, query and batch: time filters prune days, and
    a batch owns its partitions.  Batch numbers count from 0 for every query, so
    *query_id* must name the query (its checkpoint), and a new one a new query.
    """
    out = log_rows(rows, batch_id, query_id)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "query_id", "batch_id").parquet(path))


def log_sink(path: str, checkpoint: str):
    """``foreachBatch`` function that appends to the log once per batch of the query that keeps its state in *checkpoint*."""
    def write(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]
        append_predictions(batch, path, batch_id, query_id)
    return write


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return compaction.visible(spark, path, ATTACK_LOG)


def compact_log(spark: SparkSession, path: str, before: date, file_rows: int = 5_000_000) -> int:
    """Rewrite the days before *before* into a few files each; readers see every row once at any time."""
    return compaction.compact(spark, path, before, ATTACK_LOG, file_rows)


def reset_log(spark: SparkSession, path: str) -> None:
    """Empty the log, keeping its schema."""
    empty = spark.createDataFrame([], ATTACK_LOG)
    empty.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def predictions_json(predicted: DataFrame) -> DataFrame:
    """Prediction rows as JSON text: confidence and probabilities to 6 digits."""
    digits = F.transform_values("class_probabilities", lambda _, v: F.round(v, 6))
    shaped = predicted.withColumns({"confidence": F.round("confidence", 6), "class_probabilities": digits})
    if "inference_ms" in predicted.columns:
        shaped = shaped.withColumn("inference_ms", F.round("inference_ms", 4))
    return shaped.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_predictions_jsonl(
    predicted: DataFrame, path: str, max_flows: int | None = None, all_probs: bool = False,
    order: tuple[str, ...] = ("timestamp_utc",),
) -> None:
    """JSON lines, optionally the first *max_flows* in *order*, with or without the probability map."""
    rows = predicted if max_flows is None else predicted.orderBy(*order).limit(max_flows)
    if all_probs:
        rows = predictions_json(rows)
    else:
        rows = rows.drop("class_probabilities").withColumn("confidence", F.round("confidence", 6))
        rows = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.mode("overwrite").text(path)


def attack_export(log: DataFrame) -> DataFrame:
    """History rows with display texts, in export column order."""
    return log.select(
        sc.format_time("timestamp_utc").alias("Time"), F.coalesce("attack_type", F.lit("")).alias("Type"),
        sc.format_endpoint("src_ip", "src_port").alias("Source"), sc.format_endpoint("dst_ip", "dst_port").alias("Destination"),
        sc.protocol_name("protocol").alias("Proto"), sc.format_confidence("confidence").alias("Confidence"))


def export_attacks_csv(log: DataFrame, path: str) -> None:
    """CSV with a header; a value is quoted only when it holds a comma."""
    attack_export(log).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
