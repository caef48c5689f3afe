"""Periodic run detection by seed and extend along diagonals.

A run is a stretch of words with smallest period q, at least ``max(least, 2q)``
long, that no neighbouring word extends.  Equivalently: on diagonal (lag) q,
words i and i + q agree for at least ``M = max(q, least - q)`` neighbours.

* **Seeds.**  Lags are taken in classes that double.  All lags of a class
  guarantee an overlap of ``2k - 1`` words, and every such stretch holds a whole
  k-gram that begins at a multiple of k.  Every k-gram of a document is indexed;
  for those that begin at multiples of k, all later occurrences in the same
  document within the class's lags are the occurrence pairs.  A k-gram without
  period below k/2 occurs a handful of times within those lags, one with period
  p at most 4k/p times, so a class has at most in the order of n pairs.  k-grams
  of the next class are two of this one, and only those that repeat are kept.
* **Extension.**  Pairs are walked by lag and position.  A table of the furthest
  covered position per lag skips pairs inside a stretch that is known; any other
  is extended word by word both ways, which also checks the seed.  Pairs inside
  a run whose period divides their lag are skipped, too: their stretch is that run.
* A stretch on lag q is a run unless the same interval is one of a smaller
  period (two periods of a stretch of 2q words have a common divisor that is one).

Documents are worked on where they are, many at once in numpy arrays; nothing is
shuffled.  Defined results: a null or empty text has no words and no run, and
collapses to the empty text; rows that repeat are each answered; very long texts
take time in the order of n log n; empty tables give empty results; columns other
than those named are ignored by ``find`` and kept by ``collapse``.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a run has at least.
LEAST = 12
#: Bytes of text that are worked on at once; a longer document is worked on alone.
BLOCK_BYTES = 1 << 21

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit mix of integers."""
    x = x.astype(np.uint64) * _ODD
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _length(same: np.ndarray) -> int:
    """How many leading values are true."""
    return len(same) if same.all() else int(same.argmin())


def _stretch(w: np.ndarray, i: int, lag: int) -> tuple[int, int]:
    """The longest [left, right) around i on which w[x] == w[x + lag]; empty where w[i] differs."""
    left = right = i
    size = 64
    while True:
        end = min(right + size, len(w) - lag)
        n = _length(w[right:end] == w[right + lag:end + lag])
        right += n
        if right < end or end == len(w) - lag:
            break
        size *= 2
    size = 64
    while right > i and left:
        begin = max(0, left - size)
        n = _length((w[begin:left] == w[begin + lag:left + lag])[::-1])
        left -= n
        if left > begin:
            break
        size *= 2
    return left, right


class _Known:
    """Runs of small periods, by start, with the run that reaches furthest among those up to each start."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        order = np.array(sorted(runs), dtype=np.int64).reshape(-1, 3)
        self.start, self.end, self.period = order.T
        self.best = np.zeros(len(order), dtype=np.int64)
        if len(order):
            furthest = np.maximum.accumulate(self.end)
            new = np.r_[True, furthest[1:] > furthest[:-1]]
            self.best = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))

    def covers(self, i: np.ndarray, end: np.ndarray, lag: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.start, i, side="right") - 1
        if not len(self.start):
            return np.zeros(len(i), dtype=bool)
        run = self.best[np.maximum(at, 0)]
        return (at >= 0) & (self.end[run] >= end) & (lag % self.period[run] == 0)


def runs_of(w: np.ndarray, part: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of the words *w*, numbered so that equal words have equal numbers.

    *part* numbers the documents; a word that is equal to no other closes each of them.
    """
    found: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    n = len(w)
    k = max(1, ((least + 1) // 2 + 1) // 2)
    if n < 2 * k:
        return found
    grams = np.zeros(n, dtype=np.uint64)
    mixed = _mixed(w.astype(np.int64) + 1)
    for x in range(k):
        grams[:n - k + 1] = grams[:n - k + 1] * np.uint64(0xD6E8FEB86659FD93) + mixed[x:n - k + 1 + x]
    grams += _mixed(part)
    at, low = np.arange(n - k + 1), 1
    step = np.int64(4 * n)
    while len(at):
        order = np.argsort(grams[at], kind="stable")
        value, places = grams[at][order], at[order]
        first = np.r_[True, value[1:] != value[:-1]]
        group = np.cumsum(first) - 1
        repeated = np.bincount(group)[group] > 1
        places, group = places[repeated], group[repeated]
        if not len(places):
            break
        index = group * step + places  # by k-gram, then position
        anchors = index[places % k == 0]
        begin, end = np.searchsorted(index, anchors + low), np.searchsorted(index, anchors + 4 * k)
        times = end - begin
        i = np.repeat(anchors % step, times)
        j = places[np.repeat(begin - np.cumsum(times) + times, times) + np.arange(times.sum())]
        lag = j - i
        open_ = ~_Known([r for r in found if r[2] <= k]).covers(i, j + k, lag)
        i, lag = i[open_], lag[open_]
        order = np.lexsort((i, lag))
        i, lag = i[order], lag[order]
        bounds = np.flatnonzero(np.r_[True, lag[1:] != lag[:-1], True]) if len(lag) else np.zeros(1, dtype=int)
        for a, b in itertools.pairwise(bounds.tolist()):
            q, own, x = int(lag[a]), i[a:b], 0
            while x < b - a:
                left, covered = _stretch(w, int(own[x]), q)
                if covered - left >= max(q, least - q) and (left, covered + q) not in seen:
                    seen.add((left, covered + q))
                    found.append((left, covered + q, q))
                x = max(x + 1, int(np.searchsorted(own, covered)))
        alive = np.zeros(n + k, dtype=bool)
        alive[places] = True
        at = np.sort(places)
        at = at[alive[at + k]]
        doubled = np.zeros(n, dtype=np.uint64)
        doubled[at] = grams[at] * _ODD + grams[at + k]
        grams, k = doubled, 2 * k
        low = 2 * k
    return found


def _block(texts: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Words, runs by start and period, and collapsed text of each text."""
    numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
    split = [t.split() for t in texts]  # bytes split at exactly the six separators
    sizes = np.array([len(s) + 1 for s in split])
    starts = np.cumsum(sizes) - sizes
    w = np.empty(int(sizes.sum()), dtype=np.int64)
    for s, begin in zip(split, starts.tolist(), strict=True):
        w[begin:begin + len(s)] = [numbers[x] for x in s]
    w[starts + sizes - 1] = -2 - np.arange(len(split))
    found = sorted((a, q, e) for a, e, q in runs_of(w, np.repeat(np.arange(len(split)), sizes), least))
    owner = np.searchsorted(starts, [a for a, _, _ in found], side="right") - 1
    first = np.searchsorted(owner, np.arange(len(split) + 1))
    for d, words in enumerate(split):
        base = int(starts[d])
        runs = [(a - base, e - a, q) for a, q, e in found[first[d]:first[d + 1]]]
        if runs:
            change = np.zeros(len(words) + 1, dtype=np.int64)
            for a, length, q in runs:
                change[a + q] += 1
                change[a + length] -= 1
            kept = np.cumsum(change[:-1]) == 0
            yield len(words), runs, b" ".join(itertools.compress(words, kept.tolist()))
        else:
            yield len(words), runs, b" ".join(words)


def _answers(texts: pa.Array, least: int) -> Iterator[tuple[int, list, bytes]]:
    block: list[bytes] = []
    size = 0
    for value in texts.cast(pa.binary()):
        text = value.as_py() or b""
        if block and size + len(text) > BLOCK_BYTES:
            yield from _block(block, least)
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield from _block(block, least)


def find(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, its number of words, all its runs by start and period, and the text without repeats.

    The collapsed text leaves out every word that some run holds after that run's
    first period; the words that stay are joined by one space.
    """
    def work(batches):
        for batch in batches:
            answers = list(_answers(batch.column(1), least))
            runs = [[{"start": a, "length": n, "period": q} for a, n, q in r] for _, r, _ in answers]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _, _ in answers], pa.int64()), pa.array(runs, pa.list_(_RUN)),
                pa.array([c for _, _, c in answers], pa.binary()).cast(pa.string())], names=[key, "n_words", "runs", "collapsed"])

    pair = docs.select(key, text)
    return pair.mapInArrow(work, f"`{key}` {pair.schema[0].dataType.simpleString()}, {_FOUND}")


def collapse(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """The documents, all columns kept, with each text that has a run replaced by its collapsed text; others stay as they are."""
    at = docs.columns.index(text)

    def work(batches):
        for batch in batches:
            old = batch.column(at)
            new = [c if runs else t for t, (_, runs, c) in zip(old.cast(pa.binary()).to_pylist(), _answers(old, least), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(work, docs.schema)


def planted(docs: DataFrame, separators: str) -> DataFrame:
    """(doc_id, text) with a period planted into a tenth of the documents, chosen by their id.

    With h the checksum of the id's digits and g = h // 10, a document with h % 10 = 0 repeats the p words from word a on,
    a = g % n and p = 1 + (n - a) // (3 + g % 8), up to its n words.  A null id is never chosen.
    """
    words = F.filter(F.split(F.col("text"), f"{separators}+"), lambda x: x != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.when(h % 10 == 0, words)
    d = docs.select("doc_id", "text", chosen.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    d = d.withColumn("a", F.expr("cast(g % nullif(n, 0) as int)")).withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    new = F.expr("array_join(slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int)))), 1, n), ' ')")
    return d.select("doc_id", F.when(F.col("n") > 0, new).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the longest of them (ties: the first, then the smallest period), and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.withColumn("__best", best)
    length, period = F.col("__best.l"), -F.col("__best.p")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("__best.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
