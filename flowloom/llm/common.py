"""Helpers the corpus operators share: tables, shared-folder intermediates, salted joins, samples, components."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.session import shared_dir

#: Java and Python regular expressions of the characters that separate words: space and \x09-\x0D.
SPACES = r"[ \t-\r]"
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the session's shared folder; the folder goes when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/flowloom-llm/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """*df* written once as Parquet in the shared folder and read back, so it is neither computed twice nor lost with an executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(*cols: str) -> Column:
    """64-bit key of a row's content: rows that agree in all the columns share it."""
    return F.xxhash64(*[F.coalesce(F.xxhash64(F.col(c)), F.lit(7)) for c in cols], *[F.col(c).isNull() for c in cols])


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: list[str], how: str = "inner", wide: bool = False) -> DataFrame:
    """Join *many* rows a key with *one* row a key; a hot key's rows go to SALTS tasks by the hash of *spread*.

    Spark judges *one* by its size before it is repeated for every salt.  *wide*: it may have as many rows as a table, so the
    repeated rows are merged, never gathered on the driver for a broadcast.
    """
    left = many.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    right = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right.hint("merge") if wide else right, [*keys, "__salt"], how).drop("__salt")


def crc_part(modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) leaves *remainder*; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def bounded_sample(df: DataFrame, group: str, per_group: int, seed: int = 1) -> DataFrame:
    """At most *per_group* doc_ids of each value of *group*, chosen by hash: (group, doc_id).  Null doc_ids and groups never count.

    The id with the smallest hash is taken in each of *per_group* hash buckets, so
    the choice is one aggregate with fixed-width buffers and no group is sorted.
    """
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    return (df.where(F.col("doc_id").isNotNull() & F.col(group).isNotNull())
            .groupBy(group, F.pmod(h, F.lit(per_group)).alias("__bucket"))
            .agg(F.min_by("doc_id", F.xxhash64(F.col("doc_id"), F.lit(seed + 1))).alias("doc_id"))
            .select(group, "doc_id"))


def _stars(edges: DataFrame, large: bool, wide: bool = False) -> DataFrame:
    """One star step: link each node's neighbours (those above it, or those below it) with the least of them."""
    pairs = edges.select(F.col("u"), F.col("v"))
    if large:
        pairs = pairs.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = salted_join(pairs, least, ["u"], ["v"], wide=wide)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(least.select("u", F.col("m").alias("v"))))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, wide: bool = False) -> DataFrame:
    """Connected components of the edges (u, v), both orderable: (node, root) for every node with an edge, root the least node.

    Alternating large-star and small-star steps; every step is joins and
    aggregates whose hot nodes are salted, and each round is written to the
    shared folder.  The rounds end when a round changes no edge.  *wide* as in ``salted_join``.
    """
    state = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        state = stored(_stars(_stars(state, True, wide), False, wide), "edges")
    nodes = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


@functools.cache
def fold_table():
    """Code point -> folded code point as a numpy table over all of Unicode: lower case, lookalikes and digit
    substitutions to Latin letters, whatever is neither letter nor mark to a space.  Always one to one, so offsets stay."""
    import unicodedata

    import numpy as np

    # Letters that look like a Latin one, and digits or the at-sign that stand for one.
    alike = {
        "a": "аα@4", "b": "вβ8", "c": "сϲ", "e": "еε3", "h": "һн", "i": "іι1",
        "j": "ј", "k": "кκ", "m": "м", "n": "η", "o": "оο0", "p": "рρ", "s": "ѕ5",
        "t": "тτ7", "u": "υ", "v": "ν", "x": "хχ", "y": "уγ"}
    out = np.full(0x110000, ord(" "), dtype=np.uint32)
    for code in range(0x110000):
        ch = chr(code)
        if unicodedata.category(ch)[0] in "LM":
            low = unicodedata.normalize("NFKC", ch).lower()
            out[code] = ord(low) if len(low) == 1 else code
    for latin, others in alike.items():
        for ch in others:
            out[ord(ch)] = ord(latin)
            if len(ch.upper()) == 1:
                out[ord(ch.upper())] = ord(latin)
    return out
