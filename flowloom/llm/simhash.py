"""SimHash near-duplicates: fingerprints of three-word shingles, linked by a binary trie self-join.

The join walks the trie of the distinct fingerprints against itself.  A pair of
nodes at one depth carries the number of bits in which their prefixes differ;
children are paired with one more differing bit where they disagree, and a pair
is dropped as soon as the error budget is exceeded.  The top of the walk is dealt
over the cluster: every fingerprint goes to the node pairs that its prefix can
still be part of.  Pairs with too many fingerprints for one task go down further
levels in the same way; the rest are walked to the leaves inside tasks.

Because fingerprints are distinct, one has at most 1 + 64 + 2016 others within
two bits, so the walk's work stays in proportion to the fingerprints whatever
the sizes of the groups of copies.  Tasks emit a forest of their links, not all
pairs; components are then joined in Spark.

Rows: null or wordless texts have fingerprint zero and link like any other;
texts shorter than a shingle are one shingle; equal rows get equal results, also
when doc_id repeats (the component id is the least doc_id, null when a component
has none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import components, salted_join, stored

BITS = 64
#: Fingerprints that the two nodes of a pair may hold before the pair goes to a deeper level.
LEAF_ROWS = 8192
#: Rows that a task walks at once.
WALK_ROWS = 65536
STEP_BITS = 6
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _shingle_hashes(text: str | None, shingle: int, hash64) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    # bytes.split() parts at the same characters as the word pattern: space and \x09-\x0D
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([hash64(line, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([hash64(line[a:b], 42) for a, b in zip(starts[: -shingle + 1 or None].tolist(), ends[shingle - 1:].tolist())], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint as an unsigned number; a bit is 1 if it is set in over half of the shingles' XXH64."""
    import xxhash

    hashes = _shingle_hashes(text, shingle, xxhash.xxh64_intdigest)
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), 65536):  # bounded memory however long the text
        part = hashes[lo:lo + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) per row of *docs*."""
    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, budget: int) -> list[int]:
    """All differences of *bits*-bit prefixes with at most *budget* ones."""
    out = [0]
    level = [(0, -1)]
    for _ in range(min(budget, bits)):
        level = [(m | 1 << b, b) for m, last in level for b in range(last + 1, bits)]
        out += [m for m, _ in level]
    return out


def _deal(rows: DataFrame, depth: int, bits: int, budget: int) -> DataFrame:
    """Send each fingerprint to the node pairs *bits* levels further down.

    *rows*: fp, a and b (prefixes of *depth* bits of the two nodes, a <= b) and
    diff.  A pair's children differ in a mask of the next bits with a popcount
    within what is left of the budget.
    """
    def shift(n):
        return F.shiftrightunsigned("fp", BITS - n) if n else F.lit(0).cast("long")
    own = shift(depth + bits)
    masks = _masks(bits, budget)
    table = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(bin(m).count("1")).alias("cost")) for m in masks])
    out = rows.withColumn("x", F.explode(table)).where(F.col("diff") + F.col("x.cost") <= budget)
    # the other node's prefix: from the partner of this fingerprint's own node, with the masked bits changed
    other_top = F.when(shift(depth) == F.col("a"), F.col("b")).otherwise(F.col("a"))
    other = F.shiftleft(other_top, bits).bitwiseOR(own.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).bitwiseXOR(F.col("x.mask")))
    return out.select("fp", F.least(own, other).alias("a"), F.greatest(own, other).alias("b"), (F.col("diff") + F.col("x.cost")).alias("diff"))


def walk(fps: np.ndarray, roots: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the budget below the given node pairs.

    *fps* (uint64) holds sorted runs; *roots* has a row (lo1, hi1, lo2, hi2, diff)
    for each node pair, both nodes at *depth*, the same run twice for a node with itself.
    """
    found_a, found_b = [], []
    front = roots
    for level in range(depth, BITS + 1):
        sizes = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2])
        same = front[:, 0] == front[:, 2]
        front, same, sizes = front[sizes > same], same[sizes > same], sizes[sizes > same]  # a single one with itself is no pair
        small = sizes == 1
        if level == BITS:
            small[:] = True
        if small.any():
            a, b = front[small, 0], front[small, 2]
            x = fps[a] ^ fps[b]
            near = _POPCOUNT[x.view(np.uint8)].reshape(-1, 8).sum(axis=1) <= budget
            found_a.append(a[near])
            found_b.append(b[near])
            front, same = front[~small], same[~small]
        if not len(front):
            break
        bit = ((fps >> np.uint64(BITS - 1 - level)) & np.uint64(1)).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(bit)])
        lo1, hi1, lo2, hi2, diff = front.T
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        more = diff < budget
        front = np.concatenate([
            np.stack([lo1, mid1, lo2, mid2, diff], axis=1), np.stack([mid1, hi1, mid2, hi2, diff], axis=1),
            np.stack([lo1, mid1, mid2, hi2, diff + 1], axis=1)[more],
            np.stack([mid1, hi1, lo2, mid2, diff + 1], axis=1)[more & ~same]])
        front = front[(front[:, 0] < front[:, 1]) & (front[:, 2] < front[:, 3])]
    if not found_a:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of *n* items over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _walk_block(fp: np.ndarray, a: np.ndarray, b: np.ndarray, diff: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links among the rows of whole node pairs, sorted by (a, b, unsigned fp)."""
    u = fp.view(np.uint64)
    own = (u >> np.uint64(BITS - depth)).astype(np.int64) if depth else np.zeros(len(u), dtype=np.int64)
    cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(u)]])
    first = np.concatenate([[0], np.cumsum(own == a)])
    mid = lo + first[hi] - first[lo]  # the node a sorts before b
    alone = a[lo] == b[lo]
    roots = np.stack([lo, np.where(alone, hi, mid), np.where(alone, lo, mid), hi, diff[lo]], axis=1)
    roots = roots[(roots[:, 0] < roots[:, 1]) & (roots[:, 2] < roots[:, 3])]
    i, j = walk(u, roots, depth, budget)
    names, item = np.unique(fp, return_inverse=True)
    root = forest(len(names), item[i], item[j])
    linked = np.flatnonzero(root != np.arange(len(names)))
    return names[linked], names[root[linked]]


def _links_in_tasks(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out(block):
            u, v = _walk_block(block[0], block[1], block[2], block[3], depth, budget)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:4]]))
            size += batch.num_rows
            if size >= WALK_ROWS:
                block = np.concatenate(held, axis=1)
                last = np.flatnonzero((block[1] != block[1, -1]) | (block[2] != block[2, -1]))
                end = last[-1] + 1 if len(last) else 0  # the last pair may go on in the next batch
                if end:
                    yield out(block[:, :end])
                held, size = [block[:, end:]], block.shape[1] - end
        if size:
            yield out(np.concatenate(held, axis=1))

    # unsigned order of the fingerprints: flip the sign bit
    order = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    dealt = rows.select("fp", "a", "b", F.col("diff").cast("long").alias("diff")).repartition("a", "b").sortWithinPartitions("a", "b", order)
    return dealt.mapInArrow(run, "u long, v long")


def near_links(distinct: DataFrame, budget: int = 2, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of the distinct fingerprints *fp* within *budget* bits."""
    n = distinct.count()
    depth = min(32, max(4, math.ceil(math.log2(max(n, 1) / 1024 + 1e-9)))) if n else 4
    zero = F.lit(0).cast("long")
    rows = _deal(distinct.select("fp", zero.alias("a"), zero.alias("b"), F.lit(0).alias("diff")), 0, depth, budget)
    links = None
    while True:
        rows = stored(rows, "trie") if links is not None else rows
        large = (rows.groupBy("a", "b").count().where((F.col("count") > leaf_rows) & F.lit(depth < BITS))
                 .select("a", "b", F.lit(True).alias("large")))
        large = stored(large, "pairs")
        if large.isEmpty():
            found = _links_in_tasks(rows, depth, budget)
            return found if links is None else links.unionByName(found)
        marked = salted_join(rows, large, ["a", "b"], ["fp"], "left")
        found = _links_in_tasks(marked.where("large is null"), depth, budget)
        links = found if links is None else links.unionByName(found)
        step = min(STEP_BITS, BITS - depth)
        rows = _deal(marked.where("large").select("fp", "a", "b", "diff"), depth, step, budget)
        depth += step


def near_duplicates(docs: DataFrame, budget: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (least doc_id over chains of near fingerprints) per row."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = components(near_links(distinct, budget))
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "members")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = stored(salted_join(named, least, ["root"], ["fp"]).select("fp", "component_id"), "ids")
    return salted_join(prints, ids, ["fp"], ["doc_id"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

