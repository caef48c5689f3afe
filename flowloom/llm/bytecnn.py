"""Language identification by a byte convolutional network.

Lower-cased text in UTF-8 is cut into windows of a fixed number of bytes.
Filters of several widths run over embedded bytes; each filter's maximum over
the window feeds a softmax.  The network is trained in numpy.  A document's
prediction is the mean of the probabilities over the windows of its whole text.
For applying it, filters are unrolled into tables over bytes and byte pairs, so
a window costs look-ups and additions.

Training reads at most ``per_language`` documents of each language, chosen by
hash.  Rows: null texts and texts without a letter give ``und`` with score 0;
texts are read whole in bounded batches; equal rows get equal results; without
training rows every text gives ``und``; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import bounded_sample

WINDOW = 96
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 6
PER_LANGUAGE = 400
#: Training windows of one document, from its whole length at even steps.
WINDOWS_PER_DOC = 4
EPOCHS = 15
#: Windows that are run at once.
BATCH = 1024
_LETTER = regex.compile(r"\p{L}").search


def windows(text: str) -> np.ndarray:
    """The whole text's bytes in rows of WINDOW, the last one filled up with spaces."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    n = max(1, -(-len(raw) // WINDOW))
    out = np.full(n * WINDOW, 32, dtype=np.uint8)
    out[:len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    """embed (256, EMBED); filters: one (width, EMBED, FILTERS) each; biases; dense layer; names of the classes."""

    names: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    @staticmethod
    def new(names: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return Network(names, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                       [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
                       [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                       rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32), np.zeros(len(names), np.float32))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> Network:
        """Adam on the cross entropy, classes weighted to equal shares."""
        rng = np.random.default_rng(seed)
        params = [self.embed, *self.filters, *self.biases, self.dense, self.offset]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        weight = (len(y) / (len(self.names) * np.maximum(1, np.bincount(y, minlength=len(self.names))))).astype(np.float32)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), 64):
                pick = order[lo:lo + 64]
                step += 1
                for p, g, m, v in zip(params, self._gradients(x[pick], y[pick], weight), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return self

    def _gradients(self, x, y, weight):
        n, rows = len(x), np.arange(len(x))
        e = self.embed[x]
        pooled, places = [], []
        for f, b in zip(self.filters, self.biases):
            span = WINDOW - len(f) + 1
            z = sum(e[:, j:j + span] @ f[j] for j in range(len(f))) + b
            place = z.argmax(axis=1)
            places.append(place)
            pooled.append(np.take_along_axis(z, place[:, None], axis=1)[:, 0])
        pool = np.concatenate(pooled, axis=1)
        h = np.maximum(pool, 0)
        logits = h @ self.dense + self.offset
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[rows, y] -= 1
        p *= weight[y][:, None] / n
        g_pool = (p @ self.dense.T) * (pool > 0)
        g_embed, g_filters, g_biases = np.zeros_like(self.embed), [], []
        for k, (f, place) in enumerate(zip(self.filters, places)):
            g = g_pool[:, k * FILTERS:(k + 1) * FILTERS]
            g_f = np.zeros_like(f)
            for j in range(len(f)):
                byte = x[rows[:, None], place + j]
                g_f[j] = np.einsum("nfe,nf->ef", self.embed[byte], g)
                np.add.at(g_embed, byte, g[:, :, None] * f[j].T[None])
            g_filters.append(g_f)
            g_biases.append(g.sum(axis=0))
        return [g_embed, *g_filters, *g_biases, h.T @ p, p.sum(axis=0)]

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """Per width the (offset, table) parts: a table over byte pairs for two places, over bytes for a last odd one."""
        out = []
        for f, b in zip(self.filters, self.biases):
            single = [self.embed @ f[j] for j in range(len(f))]
            parts = []
            for j in range(0, len(f), 2):
                t = (single[j][:, None] + single[j + 1][None]).reshape(65536, FILTERS) if j + 1 < len(f) else single[j].copy()
                parts.append((j, np.ascontiguousarray(t + b if j == 0 else t, dtype=np.float32)))
            out.append(parts)
        return out

    def probabilities(self, x: np.ndarray, tables=None) -> np.ndarray:
        """Class probabilities of each window."""
        tables = self.tables() if tables is None else tables
        out = np.empty((len(x), len(self.names)), dtype=np.float32)
        for lo in range(0, len(x), BATCH):
            part = x[lo:lo + BATCH].T  # places first, so that the maximum runs over whole rows
            pair = (part[:-1].astype(np.int32) << 8) | part[1:]
            pooled = []
            for w, parts in zip(WIDTHS, tables):
                span = WINDOW - w + 1
                z = None
                for at, t in parts:
                    got = t.take((pair if len(t) == 65536 else part)[at:at + span], axis=0)
                    z = got if z is None else np.add(z, got, out=z)
                pooled.append(z.max(axis=0))
            logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.offset
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[lo:lo + BATCH] = p / p.sum(axis=1, keepdims=True)
        return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """Train on the rows of *docs* (doc_id, text, lang) that have a lang; None when there are none."""
    sample = bounded_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")), "lang", per_language)
    # a doc_id that repeats with other texts stands for the text with the least hash, so that reruns agree
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(sample), "doc_id").where(F.col("text").isNotNull())
            .groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
            .groupBy("doc_id").agg(F.min(F.struct("t", "lang")).alias("l")).select("doc_id", "l.t.text", "l.lang"))

    def cut(batches):
        for batch in batches:
            ids, langs, out = [], [], []
            for i, t, lang in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if not _LETTER(t.as_py()):
                    continue
                rows = windows(t.as_py())
                full = rows[:max(1, len(rows) - 1)]
                for k in np.unique(np.linspace(0, len(full) - 1, WINDOWS_PER_DOC).astype(int)).tolist():
                    ids.append(i)
                    langs.append(lang)
                    out.append(full[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["doc_id", "lang", "window"])

    got = rows.select("doc_id", "text", "lang").mapInArrow(cut, "doc_id long, lang string, window binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], r["doc_id"], bytes(r["window"])))
    names = sorted({r["lang"] for r in got})
    x = np.frombuffer(b"".join(bytes(r["window"]) for r in got), dtype=np.uint8).reshape(len(got), WINDOW)
    return Network.new(names).train(x, np.array([names.index(r["lang"]) for r in got]))


def predict(docs: DataFrame, network: Network | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of *docs*."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = shared.value
        tables = net.tables() if net else None
        for batch in batches:
            langs, scores = [], []
            pending: list[tuple[int, np.ndarray]] = []

            def flush(tables=tables, langs=langs, scores=scores, pending=pending):
                if pending:
                    p = net.probabilities(np.concatenate([w for _, w in pending]), tables)
                    at = 0
                    for slot, w in pending:
                        mean = p[at:at + len(w)].mean(axis=0)
                        at += len(w)
                        best = int(mean.argmax())
                        langs[slot], scores[slot] = net.names[best], float(min(1.0, mean[best]))
                    pending.clear()

            held = 0
            for k, t in enumerate(batch.column(2)):
                langs.append("und")
                scores.append(0.0)
                text = t.as_py()
                if net and text and _LETTER(text):
                    pending.append((k, windows(text)))
                    held += len(pending[-1][1])
                    if held >= 8 * BATCH:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])
    return (docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double"))
