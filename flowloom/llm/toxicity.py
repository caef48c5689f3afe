"""Toxicity by a weighted lexicon.

Texts are folded (lower case, lookalike letters and digit substitutions to Latin
letters, one character for one), so that a disguised word meets its plain entry.
The lexicon is learnt from labelled texts: whole words and word beginnings with
their smoothed log odds of standing in a toxic document.  One Aho-Corasick pass
finds the entries; a word counts once with its heaviest entry, and not at all
inside an exception phrase.  The sum is normalised by length and put through a
logistic curve fitted to the labelled texts.

Fitting reads at most ``per_class`` labelled documents of each class, chosen by
hash.  Rows: a null or empty text scores what no match scores; texts are read
whole; equal rows get equal scores; no labelled rows (an empty table) give an
empty lexicon and score 0.5 of the prior; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import bounded_sample, fold_table

#: Labelled documents of each class that the lexicon is learnt from, at most.
PER_CLASS = 4000
#: Lengths of word beginnings that may become entries.
STEMS = (4, 5, 6, 7)
#: Toxic documents, and different contexts in them, that an entry must stand in, and its least log odds.
LEAST_DOCS = 5
LEAST_WEIGHT = 3.0
#: The heaviest entries are kept, up to this many.
MAX_ENTRIES = 20_000
#: Words after which the sum of weights counts half.
LENGTH_SCALE = 2000.0
#: Phrases in which a word of insult is none.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clown college", "circus clown", "pathetic fallacy", "scum of milk", "pond scum", "sore loser clause")


def fold(text: str) -> str:
    """*text* folded code point by code point; a dollar sign before a letter is an s."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = fold_table()[codes]
    for at in np.flatnonzero(codes == 36)[::-1]:
        if at + 1 < len(out) and out[at + 1] != 32:
            out[at] = 115
    return out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


@dataclass(frozen=True)
class Lexicon:
    """entries: (" word " or " stem", weight); a, b: the logistic curve; exceptions: folded phrases."""

    entries: tuple[tuple[str, float], ...]
    a: float
    b: float
    exceptions: tuple[str, ...] = EXCEPTIONS


@functools.lru_cache(maxsize=2)
def _machine(lexicon: Lexicon):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for entry, weight in lexicon.entries:
        machine.add_word(entry, (len(entry), weight))
    for phrase in lexicon.exceptions:
        machine.add_word(f" {fold(phrase)} ", (len(phrase) + 2, None))
    machine.make_automaton()
    return machine


def raw_score(text: str, lexicon: Lexicon) -> float:
    """Sum of the weights of matched words, normalised by length."""
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    line = f" {fold(text)} "
    if lexicon.entries or lexicon.exceptions:
        for end, (size, weight) in _machine(lexicon).iter(line):
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            else:
                best[start] = max(best.get(start, 0.0), weight)
    total, until = 0.0, -1
    excused.sort()
    at = 0
    for start in sorted(best):  # one merge of the matches with the exception phrases, both by place
        while at < len(excused) and excused[at][0] <= start:
            until = max(until, excused[at][1])
            at += 1
        if start >= until:
            total += best[start]
    n_words = len(line.split())
    return total / (1 + n_words / LENGTH_SCALE)


def _entries(text: str) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


def _contexts(text: str, lexicon: Lexicon) -> set[tuple[str, str]]:
    """(entry, what stands around it) of each match."""
    line = f" {fold(text)} "
    if not lexicon.entries:
        return set()
    return {(line[end - size + 1:end + 1], line[max(0, end - size - 11):end + 13])
            for end, (size, weight) in _machine(lexicon).iter(line) if weight is not None}


def fit(docs: DataFrame, labelled: DataFrame, label: str, per_class: int = PER_CLASS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn a lexicon from *docs* (doc_id, text) and *labelled* (doc_id and the 0/1 column *label*)."""
    sample = bounded_sample(labelled.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)"), "y", per_class)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "y")

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
                for e in _entries(t.as_py() or ""):
                    seen.setdefault(e, [0, 0])[y] += 1
            if len(seen) > 500_000:  # hand partial counts on; they are summed by key
                yield _counts(seen)
                seen = {}
        if seen:
            yield _counts(seen)

    def _counts(seen):
        clean, toxic = zip(*seen.values())
        return pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], names=["entry", "clean", "toxic"])

    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    top = (texts.mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
           .where(F.col("toxic") >= LEAST_DOCS).select("entry", weight.alias("weight"), "toxic").where(F.col("weight") >= LEAST_WEIGHT)
           .orderBy(F.desc("weight"), F.desc("toxic"), "entry").limit(MAX_ENTRIES))
    first = Lexicon(tuple((r["entry"], float(r["weight"])) for r in top.collect()), 1.0, 0.0, exceptions)

    def contexts(batches):
        for batch in batches:
            seen = {c for t in batch.column(0) for c in _contexts(t.as_py() or "", first)}
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())], names=["entry", "context"])

    # words of a passage that is copied from text to text always stand in the same context: only entries met in enough different ones stay
    spread = (texts.where("y = 1").select("text").mapInArrow(contexts, "entry string, context string").distinct()
              .groupBy("entry").count().where(F.col("count") >= LEAST_DOCS))
    kept = {r["entry"] for r in spread.collect()}
    lexicon = Lexicon(tuple(e for e in first.entries if e[0] in kept), 1.0, 0.0, exceptions)

    def raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([raw_score(t.as_py() or "", lexicon) for t in batch.column(0)], pa.float64()), batch.column(1)], names=["raw", "y"])

    rows = texts.mapInArrow(raw, "raw double, y int").collect()  # at most 2 * per_class pairs of numbers
    a, b = _logistic(np.array([r["raw"] for r in rows]), np.array([r["y"] for r in rows], dtype=float))
    return Lexicon(lexicon.entries, a, b, exceptions)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and intercept by Newton steps on log(1 + raw), lightly regularised so that separable scores stay finite."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    z = np.stack([np.log1p(np.maximum(x, 0)), np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score_text(text: str | None, lexicon: Lexicon) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, lexicon.a * math.log1p(raw_score(text or "", lexicon)) + lexicon.b))))


def score(docs: DataFrame, lexicon: Lexicon, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted per row of *docs*."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most MAX_ENTRIES entries

    def run(batches):
        for batch in batches:
            s = np.array([score_text(t.as_py(), shared.value) for t in batch.column(2)], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])
    return (docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"))
