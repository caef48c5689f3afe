"""Readers: labelled-flow CSV files, their checks and checksums, cleaned tables."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from flowloom import fixed_values as fv
from flowloom.functions.scalar import capture_day


def csv_headers(spark: SparkSession, path: str) -> dict[str, tuple[list[str], int]]:
    """The distinct headers of the CSV files under *path* (names stripped) and their numbers of files, by the first file that has each.

    One distributed job over the files' first blocks; blocks pass by and are never sorted; files come together by header, so the driver sees no list of files.
    """
    def heads(batches):
        seen = set()  # the files of a task whose first line went by
        for batch in batches:
            files, at = batch.column(0), []
            for file in files.unique().to_pylist():
                if file not in seen:
                    seen.add(file)
                    at.append(pc.index(files, file).as_py())
            if at:
                yield batch.take(pa.array(at, pa.int64()))

    meta = F.col("_metadata")
    lines = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).text(path).select(
        meta.file_path.alias("file"), "value", meta.file_block_start.alias("block")).filter("block = 0").select("file", "value")
    first = lines.mapInArrow(heads, "file string, value string").withColumnRenamed("value", "header")  # the block that begins a file is read in order by one task
    found = first.groupBy("header").agg(F.count("*").alias("files"), F.min("file").alias("file")).collect()
    return {r["file"].rsplit("/", 1)[-1]: ([c.strip() for c in r["header"].split(",")], r["files"]) for r in sorted(found, key=lambda r: r["file"])}


def validate_labelled(
    headers: dict[str, tuple[list[str], int]], expected_files: int | None = None,
    expected_cols: int | None = None, target: str = fv.TARGET,
) -> list[str]:
    """Check file count, column count, equal headers, repeated names and the label column; returns the header."""
    n_files = sum(n for _, n in headers.values())
    if expected_files is not None and n_files != expected_files:
        raise ValueError(f"expected {expected_files} CSV files, found {n_files}")
    if not headers:
        raise ValueError("no CSV files found")
    first = next(iter(headers.values()))[0]
    for file, (cols, _) in headers.items():
        repeated = sorted({c for c in cols if cols.count(c) > 1})
        if repeated:
            raise ValueError(f"{file}: repeated column names {repeated}")
        if target not in cols:
            raise ValueError(f"{file}: no column {target!r}")
        if expected_cols is not None and len(cols) != expected_cols:
            raise ValueError(f"{file}: {len(cols)} columns, expected {expected_cols}")
        if cols != first:
            raise ValueError(f"{file}: header differs from the other files")
    return first


def read_labelled_csv(
    spark: SparkSession, path: str, expected_files: int | None = None,
    expected_cols: int | None = None, ordinals: bool = True,
) -> DataFrame:
    """All CSV files of a directory as text columns (snake_case) with label and provenance.

    The header is checked in every file first; ``_source_row`` is the row's
    true position in its file.
    """
    header = validate_labelled(csv_headers(spark, path), expected_files, expected_cols)
    names = [c if c == fv.TARGET else fv.snake(c) for c in header]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True)
        .option("pathGlobFilter", "*.csv").csv(path))
    meta = F.col("_metadata")
    df = raw.select(*names, meta.file_name.alias("_source_file"), meta.file_path.alias("_path"), meta.file_block_start.alias("_block"))
    df = df.withColumn("_capture_day", capture_day("_source_file"))
    df = with_source_row(df, "_path") if ordinals else df.withColumn("_source_row", F.lit(None).cast("long"))
    features = [n for n in names if n != fv.TARGET]
    return df.select(*features, *fv.PROVENANCE, fv.TARGET)


def with_source_row(df: DataFrame, file_col: str = "_source_file", block_col: str = "_block") -> DataFrame:
    """Row number within the file (from 0) without sorting.

    Rows of one file block are read in order by one task, so a row's number is
    its place in the block plus the rows of the file's earlier blocks.
    """
    numbered = df.withColumn("_id", F.monotonically_increasing_id())
    blocks = numbered.groupBy(file_col, block_col).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    earlier = W.partitionBy(file_col).orderBy(block_col).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(file_col, block_col, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # one row per block: few enough that adaptive execution broadcasts them and the rows themselves stay where they are
    return numbered.join(blocks, [file_col, block_col]).withColumn(
        "_source_row", F.col("_before") + F.col("_id") - F.col("_first")).drop("_id", "_first", "_before", block_col)


def file_checksums(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """File name, bytes and SHA-256 of every file (each below 2 GB)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"),
        F.sha2(F.col("content"), 256).alias("sha256"))


def file_manifest(spark: SparkSession, path: str, labelled: DataFrame) -> DataFrame:
    """The manifest of raw files: checksum, bytes, rows, columns and label counts."""
    from flowloom.operators.clean import raw_manifest

    return file_checksums(spark, path).join(raw_manifest(labelled), "file")


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """A cleaned table, after checking that it has its columns, rows and labels."""
    df = spark.read.parquet(path)
    missing = [c for c in (fv.TARGET, *fv.PROVENANCE) if c not in df.columns]
    if missing:
        raise ValueError(f"cleaned table lacks {missing}")
    check = df.agg(F.count("*").alias("rows"), F.count_if(F.col(fv.TARGET).isNull()).alias("unlabelled")).first()
    if check["rows"] == 0:
        raise ValueError("cleaned table is empty")
    if check["unlabelled"]:
        raise ValueError(f"cleaned table has {check['unlabelled']} rows without label")
    return df
