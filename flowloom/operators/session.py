"""Session helpers shared by operators that cut lineage or check a side's size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors that the session names in ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a folder of its own;
    on a cluster a missing setting is an error, because a machine-local folder
    would not survive the loss of an executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="flowloom-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; the folder goes when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/flowloom/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame) -> DataFrame:
    """*df* written once as Parquet in the shared folder and read back, so later stages neither recompute it nor lose it with an executor."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators count on.

    Times are UTC.  Generated methods beyond 8,000 bytes are never compiled by
    the JVM's just-in-time compiler, so wide projections run faster when Spark
    splits them than when it fuses them.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark
