"""Quality rules with cross-document line frequency, in DataFrame functions only.

Each line is normalised (lower case, digits to zero, white space collapsed) and
hashed.  For every host the distinct documents that hold a line are counted;
exact copies of a text are one document.  A line above the limits is removed
from that host's documents, and a document of which the removal takes too large
a share is rejected as depleted.

Rows: a null text has no words and no lines, fails the base rule and is not
kept; a null source is a host of its own; equal rows get equal results, and rows
that share a doc_id but differ are judged apart; texts are read whole, however
long; an empty table gives no rows; extra columns pass through ``clean`` and are
ignored by ``verdicts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import SPACES, row_key, salted_join, stored

WINDOW = 8
MIN_WORDS = 20
#: Percent of the words that may lie in repeated windows.
MAX_REPEAT_PERCENT = 30
#: A line is removed from a host's documents when more than this many documents and this percent of the host's hold it.
MAX_LINE_DOCS = 20
MAX_LINE_PERCENT = 5
#: A line of at least this many words is removed above MAX_LINE_DOCS documents whatever the host's size: long lines don't repeat by chance.
LONG_LINE_WORDS = 10
#: Percent of a document's line characters whose removal rejects it.
MAX_REMOVED_PERCENT = 80


def _let(value: Column, body) -> Column:
    """*body* over *value*, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort the hashes with their places, keep equal neighbours."""
    def repeated(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        return F.sort_array(F.transform(F.filter(pairs, lambda p, i: (
            ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"])) | ((i < last) & (F.get(pairs, i + 1)["h"] == p["h"])))), lambda p: p["i"]))

    def length(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(places, i - 1))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(pairs, lambda s: _let(repeated(s), length))


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, source, row_key, the base counts and ``lines``: an array of (hash, characters) of the lines with a word.  A row per row of *docs*."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    df = df.select("doc_id", "source", row_key("doc_id", "source", "text").alias("row_key"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    df = df.select(
        "doc_id", "source", "row_key", "text_key", words(F.col("text")).alias("words"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("text_lines"))
    df = df.select(
        "doc_id", "source", "row_key", "text_key", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("text_lines") - F.size(F.array_distinct("text_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("text_lines", lambda x: F.struct(line_hash(x).alias("hash"), F.length(x).alias("chars"), (F.size(words(x)) >= LONG_LINE_WORDS).alias("long"))).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    windows = F.when(F.size("hashes") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("hashes") - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("windows", windows).drop("hashes")
    repeats = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(_covered(F.col("windows")))
    return df.withColumn("n_repeat_words", repeats).drop("windows")


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACES + "+", " ")))


def _frequent(metrics: DataFrame) -> DataFrame:
    """(source, hash) of the lines above the limits of their host."""
    texts = metrics.select("source", "text_key", "lines").dropDuplicates(["source", "text_key"])
    hosts = texts.groupBy("source").agg(F.count("*").alias("host_docs"))
    own = F.array_distinct(F.transform("lines", lambda x: F.struct(x["hash"].alias("hash"), x["long"].alias("long"))))  # equal hashes have equally many words
    counts = (texts.select("source", F.explode(own).alias("line")).groupBy("source", F.col("line.hash").alias("hash"))
              .agg(F.count("*").alias("docs"), F.max("line.long").alias("long")).where(F.col("docs") > MAX_LINE_DOCS))
    joined = counts.join(hosts, counts["source"].eqNullSafe(hosts["source"]))
    return joined.where(F.col("long") | (100 * F.col("docs") > MAX_LINE_PERCENT * F.col("host_docs"))).select(counts["source"], "hash")


def _judged(docs: DataFrame) -> DataFrame:
    """Metrics, verdict and the hashes of removed lines per distinct document row."""
    metrics = stored(base_metrics(docs), "metrics")
    tag = F.coalesce(F.xxhash64("source"), F.lit(7))  # the join key where a null host meets itself
    frequent = _frequent(metrics).select(tag.alias("host"), "hash", F.lit(True).alias("frequent"))
    lines = metrics.select("doc_id", "row_key", tag.alias("host"), F.posexplode("lines").alias("place", "line")).select(
        "doc_id", "row_key", "host", "place", F.col("line.hash").alias("hash"), F.col("line.chars").alias("chars"))
    # a repeated row has its lines again at the same places: a place counts once, within the one shuffle that gathers a document's hits
    hit = salted_join(lines, frequent, ["host", "hash"], ["doc_id", "row_key"]).repartition("doc_id", "row_key")
    removed = hit.groupBy("doc_id", "row_key", "place").agg(F.first("hash").alias("hash"), F.first("chars").alias("chars")).groupBy("doc_id", "row_key").agg(
        F.sum("chars").alias("removed_chars"), F.count("*").alias("n_removed_lines"), F.collect_set("hash").alias("removed"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    out = metrics.alias("m").join(removed.alias("r"), (F.col("m.row_key") == F.col("r.row_key")) & F.col("m.doc_id").eqNullSafe(F.col("r.doc_id")), "left")
    out = out.select(
        "m.doc_id", "m.row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.coalesce("n_removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"),
        (100 * F.coalesce("removed_chars", F.lit(0)) > MAX_REMOVED_PERCENT * total).alias("depleted"), "removed")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def verdicts(docs: DataFrame) -> DataFrame:
    """A row per row of *docs*: doc_id, the base counts, base_failed, kept, n_removed_lines, depleted."""
    return _judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                                "n_removed_lines", "depleted")


def clean(docs: DataFrame) -> DataFrame:
    """The kept rows of *docs*, with the lines above the limits removed from ``text`` (and ``n_chars``, if there is one, counted anew)."""
    judged = _judged(docs).where("kept").select(F.col("row_key").alias("key"), F.col("doc_id").alias("id"), "removed").dropDuplicates(["key", "id"])
    # the document's columns travel in one struct, where no name of theirs can meet one of ours
    rows = docs.select(F.struct("*").alias("doc"), row_key("doc_id", "source", "text").alias("row"), F.col("doc_id").cast("long").alias("own"))
    joined = rows.join(judged, (F.col("row") == F.col("key")) & F.col("own").eqNullSafe(F.col("id")))
    text = F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(
        F.array_join(F.filter(F.split(F.col("doc.text"), "\n"), lambda x: ~F.array_contains("removed", line_hash(x))), "\n"))
    joined = joined.withColumn("text", text)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("removed").isNull(), F.col("doc.n_chars")).otherwise(F.length("text").cast("long")) if "n_chars" in docs.columns else None}
    return joined.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
