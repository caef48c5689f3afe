"""A corpus pipeline of five stages, each an operator of flowloom.llm over all that the stage before has kept.

Every stage writes Parquet to the session's shared folder and the next one reads
it.  Stages keep the columns of ``documents``; the last returns the encoded
documents.  A document that the mix repeats is there as often as it is taken.

Defined results: an empty table gives no rows at every stage.  A null or empty
text fails the quality rules, so no later stage of a run meets one; a stage that
is called alone takes it as the operator's module states.  Equal rows are judged
alike; the near-duplicate stage keeps every row of the least doc_id.  Texts are
read whole, however long.  Other columns travel on under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import bpe, mixing, neartext, pii, quality
from flowloom.llm.common import new_folder, table
from flowloom.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines above the limits of their host."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near texts: five-word shingles, similarity of 0.8 or more, found by SimHash and the trie self-join, checked exactly."""
    return neartext.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each document."""
    return bpe.encode_digests(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("near duplicates", near_dedup), ("personal data", redact), ("mix", mix), ("encode", encode)]

#: SQL can't express the fingerprints and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
