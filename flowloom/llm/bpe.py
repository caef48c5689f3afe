"""Byte-pair encoding and decoding by a pair occurrence index.

A block of texts is cut into pieces; the distinct pieces' symbols lie one after
another in one array.  An index maps every adjacent pair that has a merge to all
its positions in the block.  Active ranks are applied in ascending order: all
positions of a rank are merged at once and the lists of the pairs that arise
beside them are updated.  In the vocabulary a merge always ranks behind those
that make its parts (checked on loading), so ascending order gives what merging
word by word gives.

Texts: null is an empty text (no ids, empty decoded text); texts are encoded
whole; equal rows get equal results; an empty table gives no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The white space beyond ASCII.
FAR_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters (L), numbers (N) and lower-case letters of newer Unicode versions that the tokenizer's library knows and the interpreter may not.
NEWER = {
    "L": [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
          (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
          (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]}
NEWER_LOWER = [(0x1C89, 0x1C8A), (0xA7CB, 0x264), (0xA7CC, 0xA7CD), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D3), (0xA7D4, 0xA7D5), (0xA7DA, 0xA7DB), (0xA7DC, 0x19B),
               *[(c, c + 0x20) for c in range(0x10D50, 0x10D66)], *[(c, c + 0x1B) for c in range(0x16EA0, 0x16EB9)]]
#: Code points encoded together: a block's index and cache are dropped with the block.
BLOCK_CHARS = 6_000_000
OUTPUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


@functools.cache
def _class(name: str) -> str:
    """Body of a character class with every code point whose general category begins with *name*."""
    runs: list[list[int]] = []
    newer = {code for a, b in NEWER[name] for code in range(a, b + 1)}
    for code in range(0x110000):
        if unicodedata.category(chr(code))[0] == name or code in newer:
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


_NEWER_UPPER = re.compile("[" + "".join(chr(a) for a, _ in NEWER_LOWER) + "]").search


class Vocabulary:
    """Merges and tokens of a tokenizer file with word-end suffix, lower-casing and white-space removal."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for text, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = text
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        self.left, self.right = left, right
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int32)
        born = np.full(len(self.tokens), -1, dtype=np.int64)
        np.maximum.at(born, self.made, np.arange(len(merges)))
        if (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge ranks before one that makes its parts")
        keys = (left << 32) | right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        letters = _byte_letters()
        self.byte_id = np.array([ids[x] for x in letters], dtype=np.int32)
        self.last_byte_id = np.array([ids[x + end] for x in letters], dtype=np.int32)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        for name in "LN":
            split = split.replace(f"[\\p{{{name}}}]", f"[{_class(name)}]").replace(f"\\p{{{name}}}", _class(name))
        self.pieces = re.compile(split.replace("\\s", " ")).findall  # the normaliser leaves no other white space
        self.names = pa.array(self.tokens, pa.string())
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where they don't merge (a symbol of -1 never does)."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.by_key[at], -1)

    def normalise(self, text: str) -> str:
        """Canonical composition, white space to spaces, lower case by code point.  Runs of spaces stay; they part words all the same."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            for ch in FAR_SPACES:
                if ch in text:
                    text = text.replace(ch, " ")
            if _NEWER_UPPER(text):
                text = text.translate(dict(NEWER_LOWER))
        for ch in "\t\n\v\f\r":
            text = text.replace(ch, " ")
        return text.lower()


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _by_rank(ranks: np.ndarray, where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The positions of each rank, in ascending order."""
    fits = ranks >= 0
    ranks, where = ranks[fits], where[fits]
    if len(ranks):
        order = np.argsort(ranks * len(ranks) + np.arange(len(ranks)))
        ranks, where = ranks[order], where[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        starts = [0, *cuts.tolist()]
        for rank, lo, hi in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)]):
            yield rank, where[lo:hi]


def encode_pieces(pieces: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another and where each piece's ids end, by the pair occurrence index over all pieces.
    An empty piece gets one id of 0, a place that the caller fills."""
    if not pieces:
        return np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
    raw = pa.array(pieces, pa.string())
    sizes = np.maximum(pc.binary_length(raw).to_numpy(), 1)
    ends = np.cumsum(sizes + 1) - 1  # a wall of -1 stands behind each piece
    n = int(ends[-1]) + 1
    octets = np.zeros(n, dtype=np.uint8)
    inside = np.ones(n, dtype=bool)
    inside[ends] = False
    if "" in pieces:
        inside[ends[pc.equal(raw, "").to_numpy(zero_copy_only=False)] - 1] = False
    lo, hi = raw.offset, raw.offset + len(raw)
    bounds = np.frombuffer(raw.buffers()[1], dtype=np.int32)
    octets[inside] = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[bounds[lo]:bounds[hi]]
    sym = vocab.byte_id[octets]
    sym[ends - 1] = np.where(inside[ends - 1], vocab.last_byte_id[octets[ends - 1]], 0)
    sym[ends] = -1
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    index: dict[int, list[np.ndarray]] = {}
    for rank, where in _by_rank(vocab.ranks(sym[:-1], sym[1:]), np.arange(n - 1)):
        index[rank] = [where]
    active = sorted(index)
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        a, b, made = vocab.left[rank], vocab.right[rank], vocab.made[rank]
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        nxt = after[at]
        keep = (sym[at] == a) & (sym[nxt] == b)
        if a == b and len(at) > 1:  # in a run of one symbol every other position merges, from the left
            at = np.unique(at[keep])
            nxt = after[at]
            joins = np.zeros(len(at), dtype=bool)
            joins[1:] = nxt[:-1] == at[1:]
            first = np.maximum.accumulate(np.where(joins, 0, np.arange(len(at))))
            keep = (np.arange(len(at)) - first) % 2 == 0
        at, nxt = at[keep], nxt[keep]
        if not len(at):
            continue
        sym[at] = made
        sym[nxt] = -2
        beyond = after[nxt]
        after[at] = beyond
        before[beyond] = at
        prior = before[at]
        has = prior >= 0
        prior = prior[has]
        spots = np.concatenate([prior, at])
        new = vocab.ranks(np.concatenate([sym[prior], sym[at]]), np.concatenate([sym[at[has]], sym[beyond]]))
        for r, where in _by_rank(new, spots):
            known = index.get(r)
            if known is None:
                index[r] = [where]
                heapq.heappush(active, r)
            else:
                known.append(where)
    left = np.flatnonzero(sym >= 0)
    return sym[left].astype("<u4"), np.searchsorted(left, ends)


def _spread(offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the items of the picked lists, one list after another, and the lists' new offsets."""
    sizes = np.diff(offsets)[picks]
    ends = np.cumsum(sizes)
    starts = offsets[:-1][picks] - (ends - sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts, sizes), np.concatenate([[0], ends])


def encode_block(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All ids, the offsets of each text's ids, and the decoded texts."""
    clean = pa.array([vocab.normalise(t) if "<|" not in t else " ".join(
        f"\n{part}" if i % 2 else vocab.normalise(part) for i, part in enumerate(vocab.cut(t))) for t in texts], pa.string())
    split = pc.split_pattern(clean, " ")
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    # words and their pieces; a special token's word begins with the line feed that no other word can hold
    special = {f"\n{w}": i for w, i in vocab.special.items()}
    cut = [vocab.pieces(w) if w not in special else [""] for w in words]
    ids, ends = encode_pieces([p for ps in cut for p in ps], vocab)
    at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(ps) for ps in cut], dtype=np.int64)])]
    for k, w in enumerate(words):
        if w in special:
            ids[at[k]] = special[w]
    names = pa.ListArray.from_arrays(pa.array(at, pa.int32()), vocab.names.take(pa.array(ids)))
    names = pc.binary_join(names, " ")
    picks = coded.indices.to_numpy()
    full = (np.diff(at) > 0)[picks]  # drops the empty words between spaces
    bounds = np.concatenate([[0], np.cumsum(full)])[split.offsets.to_numpy()]
    picks = picks[full]
    decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), names.take(pa.array(picks))), " ")
    where, offsets = _spread(at, picks)
    return ids[where], offsets[bounds], decoded


def decode(ids: list[int], vocab: Vocabulary) -> str:
    """The tokens of *ids*, special ones too, joined by a space: the file names no other decoder."""
    return " ".join([vocab.tokens[i] for i in ids])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = t.as_py() or ""
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded text of every document; *path* names the tokenizer file on every executor."""
    def run(batches):
        vocab = vocabulary(path)
        for ids, texts in _blocks(batches):
            flat, bounds, decoded = encode_block(texts, vocab)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32))), decoded],
                names=["doc_id", "ids", "decoded"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of tokens and the SHA-256 of ids and decoded text, digested where they are made."""
    def run(batches):
        vocab = vocabulary(path)
        for ids, texts in _blocks(batches):
            flat, bounds, decoded = encode_block(texts, vocab)
            raw, cuts = memoryview(flat.tobytes()), (4 * bounds).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                pa.array([hashlib.sha256(raw[lo:hi]).hexdigest() for lo, hi in zip(cuts[:-1], cuts[1:])], pa.string()),
                pa.array([hashlib.sha256(d.as_buffer()).hexdigest() for d in decoded], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUTPUT)
