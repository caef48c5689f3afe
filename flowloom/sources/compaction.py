"""Compaction of the prediction log: closed days rewritten into a few files, swapped in by a manifest.

Beside the batches' own folders the log keeps, out of sight of plain readers:

``_compacted/data/generation=<g>/day=<d>``  the rewritten days
``_compacted/manifest/<n>``                 table n of (day, query_id, batch_id, generation): batches that were rewritten, and where to

A manifest counts when its writer has finished (``_SUCCESS``); the highest
number is in force.  A reader takes the batches that its manifest does not name
and the generations that it does, so it sees every row once, whether or not
the old folders are still there.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BATCH = ("day", "query_id", "batch_id")
MANIFEST = T.StructType([
    T.StructField("day", T.DateType()), T.StructField("query_id", T.StringType()),
    T.StructField("batch_id", T.LongType()), T.StructField("generation", T.StringType())])


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, hadoop = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def manifest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(number, table) of the manifest in force; number 0 and no rows before the first compaction."""
    root = f"{path.rstrip('/')}/_compacted/manifest"
    done = [int(n) for n in _children(spark, root) if n.isdigit() and "_SUCCESS" in _children(spark, f"{root}/{n}")]
    if not done:
        return 0, spark.createDataFrame([], MANIFEST)
    return max(done), spark.read.schema(MANIFEST).parquet(f"{root}/{max(done)}")


def _places(table: DataFrame) -> list[tuple[str, str]]:
    """(generation, day) of every rewritten day: one entry a day."""
    return [(r["generation"], r["day"].isoformat()) for r in table.select("generation", "day").distinct().collect()]


def _rewritten(spark: SparkSession, path: str, places: list[tuple[str, str]], schema: T.StructType) -> DataFrame:
    base = f"{path.rstrip('/')}/_compacted/data"
    if not places:
        return spark.createDataFrame([], schema)
    paths = [f"{base}/generation={g}/day={d}" for g, d in sorted(places)]
    return spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)


def visible(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of the log, each once."""
    number, table = manifest(spark, path)
    raw = spark.read.schema(schema).parquet(path)
    if not number:
        return raw
    fresh = raw.join(table.select(*_BATCH), list(_BATCH), "left_anti").select(*schema.names)
    return fresh.unionByName(_rewritten(spark, path, _places(table), schema))


def compact(spark: SparkSession, path: str, before: datetime.date, schema: T.StructType, file_rows: int = 5_000_000) -> int:
    """Rewrite days earlier than *before* that have batches of their own into files of about *file_rows* rows; the number of days.

    A day that gets a late batch is rewritten again, with what was rewritten of it
    before.  A day of any size is dealt over tasks by row.  A compaction that
    dies leaves files that no manifest names.  Run one at a time: of two, the later
    manifest counts, and what the other rewrote is read from its batches again.
    Rows without a day stay where they are.
    """
    path = path.rstrip("/")
    _, table = manifest(spark, path)
    raw = spark.read.schema(schema).parquet(path)
    taken = raw.filter(F.col("day") < F.lit(before)).select(*_BATCH).distinct().join(table.select(*_BATCH), list(_BATCH), "left_anti")
    taken = spark.createDataFrame(taken.collect(), T.StructType(MANIFEST.fields[:3]))  # one row a batch folder
    days = {r["day"] for r in taken.select("day").distinct().collect()}
    if not days:
        return 0
    old = [(g, d) for g, d in _places(table) if datetime.date.fromisoformat(d) in days]
    rows = raw.join(taken, list(_BATCH), "left_semi").select(*schema.names).unionByName(_rewritten(spark, path, old, schema))
    sizes = {r["day"]: r["count"] for r in rows.groupBy("day").count().collect()}  # one row a day
    slices = spark.createDataFrame([(d, -(-n // file_rows)) for d, n in sizes.items()], "day date, _files long")
    dealt = rows.join(slices, "day").withColumn("_slice", F.pmod(F.xxhash64("id"), F.col("_files")))
    generation = uuid.uuid4().hex
    (dealt.repartition(sum(-(-n // file_rows) for n in sizes.values()), "day", "_slice").drop("_files", "_slice")
     .sortWithinPartitions("day", "timestamp_utc").write.partitionBy("day").option("compression", "zstd")
     .parquet(f"{path}/_compacted/data/generation={generation}"))
    kept = table.withColumn("generation", F.when(F.col("day").isin(list(days)), F.lit(generation)).otherwise(F.col("generation")))
    following = kept.unionByName(taken.withColumn("generation", F.lit(generation)))
    used = [int(n) for n in _children(spark, f"{path}/_compacted/manifest") if n.isdigit()]  # unfinished ones too
    following.coalesce(1).write.mode("errorifexists").parquet(f"{path}/_compacted/manifest/{max(used, default=0) + 1}")
    return len(days)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete what the manifest in force has replaced; the number of folders.  Call it when no reader of an earlier one is left and nothing is being compacted."""
    path = path.rstrip("/")
    number, table = manifest(spark, path)
    if not number:
        return 0
    named = {(r["day"], r["query_id"], r["batch_id"]) for r in table.select(*_BATCH).collect()}
    folders = [f"{path}/day={d}/query_id={q}/batch_id={b}" for d, q, b in named]
    places = set(_places(table))
    data = f"{path}/_compacted/data"
    for g in _children(spark, data):
        current = {d for k, d in places if f"generation={k}" == g}
        folders += [f"{data}/{g}/{d}" for d in _children(spark, f"{data}/{g}") if d.startswith("day=") and d[4:] not in current]
    folders += [f"{path}/_compacted/manifest/{n}" for n in _children(spark, f"{path}/_compacted/manifest") if n.isdigit() and int(n) < number]
    gone = 0
    for f in folders:
        fs, hadoop = _folder(spark, f)
        gone += bool(fs.exists(hadoop) and fs.delete(hadoop, True))
    return gone
