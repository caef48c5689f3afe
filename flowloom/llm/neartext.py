"""Near-duplicate texts by SimHash over five-word shingles, found by the binary trie self-join and checked exactly.

A link is a shingle-set similarity (Jaccard) of 0.8 or more.  One 64-bit
fingerprint cannot find those: at 0.8 about 15 % of its bits differ.  So a text
has a sketch of 16 fingerprints of 24 bits, and each is joined for itself with
an error budget of one bit: of the two halves of a fingerprint one must agree,
which deals the texts to the subtries below equal halves; inside, node pairs
are walked together and dropped beyond the budget (``simhash.walk``).  Of the
pairs found, those whose whole sketches differ in few enough bits are the
candidates.  A shortest forest of them is checked in Spark against the true
shingle sets first.  Where the check refuses a link of a forest, every other
candidate between texts that the links which hold don't join yet is checked as
well, so a component is that of all candidates that hold; near copies, which
their forest joins, are never compared pair by pair.

Expected share of links found, pair by pair: 0.83 at a similarity of 0.8, 0.94
at 0.85, 0.99 at 0.9 (the tests measure it); a link is never wrong, but for
texts that share a 64-bit hash.  Subtries with more than ``PART_ROWS`` texts are
compared in pairs of blocks, each in a task of its own.

Defined results: upper and lower case A-Z and the white space between words do
not count; a text of fewer than five words is one shingle; null and wordless
texts are equal to one another; equal rows get equal results; an empty table
gives no rows; other columns are ignored, ``one_of_each`` keeps them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import components, salted_join, stored
from flowloom.llm.simhash import _LOWER, _POPCOUNT, _shingle_hashes, walk

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
BAND_BITS = 24
WORDS = BANDS * BAND_BITS // 64
#: Texts of a subtrie that one task compares.
PART_ROWS = 65536
#: Rows that are walked at once, and member pairs whose sketches are compared at once.
BLOCK_ROWS = 131072
PAIRS = 1 << 18
#: Links of one text that one task checks.
LINKS = 256
#: Shingle sets that a task keeps while it checks links.
SETS = 64


def budget(similarity: float) -> int:
    """Differing bits of whole sketches that a pair of this similarity stays within in 98 of 100 cases."""
    cosine = 2 * similarity / (1 + similarity)
    p = math.acos(min(1.0, cosine)) / math.pi
    n = BANDS * BAND_BITS
    return math.ceil(n * p + 2 * math.sqrt(n * p * (1 - p)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending."""
    import xxhash

    return np.unique(_shingle_hashes(text, shingle, xxhash.xxh64_intdigest))


def sketch(hashes: np.ndarray) -> bytes:
    """The majority bits of a shingle set under WORDS independent hashes."""
    out = []
    for word in range(WORDS):
        ones = np.zeros(64, dtype=np.int64)
        for lo in range(0, len(hashes), 65536):
            part = _mixed(hashes[lo:lo + 65536] + np.uint64((word + 1) * 0x9E3779B97F4A7C15 % 2**64))
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(hashes)))
    return np.concatenate(out).tobytes()


def text_key(text: str | None) -> int:
    """64-bit hash of the words, as a signed number."""
    import xxhash

    line = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([text_key(t) for t in texts], pa.int64()),
                pa.array([sketch(shingle_set(t, shingle)) for t in texts], pa.binary())], names=["doc_id", "key", "sketch"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, key long, sketch binary")


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), WORDS * 8)


def bands_of(sketches: np.ndarray) -> np.ndarray:
    """The 24-bit fingerprints of each sketch (rows of bytes)."""
    b = sketches.reshape(len(sketches), BANDS, 3).astype(np.int64)
    return b[:, :, 0] << 16 | b[:, :, 1] << 8 | b[:, :, 2]


def _dealt(nodes: DataFrame) -> DataFrame:
    """Each text to the subtries of its fingerprints' halves: part = band, which half, the half's value; rest = the other half.  A column ``root`` goes along."""
    along = ["key", "sketch", *[c for c in nodes.columns if c == "root"]]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = bands_of(_words(batch.column(1)))
            high, low = v >> 12, v & 4095
            band = np.arange(BANDS) << 13
            part = np.stack([band + high, band + 4096 + low], axis=2).reshape(-1)
            rest = np.stack([low, high], axis=2).reshape(-1)
            each = pa.array(np.repeat(np.arange(len(batch)), 2 * BANDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(rest), *[c.take(each) for c in batch.columns]], names=["part", "rest", *along])
    return nodes.select(*along).mapInArrow(run, "part long, rest long, key long, sketch binary" + (", root long" if "root" in along else ""))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _POPCOUNT[a ^ b].sum(axis=-1, dtype=np.int64)


def shortest_forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of links (a, b) of length d that form a shortest spanning forest of *n* items: each component takes its shortest link out, again and again."""
    root, taken = np.arange(n), []
    order = np.lexsort((b, a, d))  # one strict order, so that the links taken together close no circle
    while len(order):
        ra, rb = root[a[order]], root[b[order]]
        order, ra, rb = order[ra != rb], ra[ra != rb], rb[ra != rb]
        if not len(order):
            break
        first = np.full(n, len(order))
        np.minimum.at(first, ra, np.arange(len(order)))
        np.minimum.at(first, rb, np.arange(len(order)))
        best = np.unique(first[first < len(order)])
        taken.append(order[best])
        x, y = ra[best], rb[best]
        while True:  # merge the components that the links join
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            while (root[root] != root).any():
                root = root[root]
            if (before == root).all():
                break
    return np.concatenate(taken) if taken else np.empty(0, dtype=np.int64)


def linked_group(sketches: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among a large group whose components are those of all its pairs within *most* bits.

    Items are taken as leaders until each is near one; a leader is compared with all
    and joins whatever is near it.  If more than one component is left, the items
    outside the largest are compared with all others.
    """
    n = len(sketches)
    root, open_ = np.arange(n), np.ones(n, dtype=bool)
    a, b = [], []

    def join(i: int) -> np.ndarray:
        d = _apart(sketches, sketches[i])
        near = np.flatnonzero((d <= most) & (root != root[i]))
        roots, first = np.unique(root[near[np.argsort(d[near], kind="stable")]], return_index=True)
        if len(roots):
            ends = near[np.argsort(d[near], kind="stable")][first]
            a.extend([i] * len(ends))
            b.extend(ends.tolist())
            root[np.isin(root, roots)] = root[i]
        return d <= most

    while open_.any():
        i = int(open_.argmax())
        open_ &= ~join(i)
    names, sizes = np.unique(root, return_counts=True)
    if len(names) > 1:
        for i in np.flatnonzero(root != names[sizes.argmax()]).tolist():
            join(i)
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _near_groups(part: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of rows with equal part and rest, among rows sorted by both: (first row, row behind the last, group, group), the last two
    all pairs of groups of one part whose rest differs in one bit at most, groups of several rows with themselves."""
    new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (rest[1:] != rest[:-1])])
    end = np.r_[new[1:], len(part)]
    values = rest[new].astype(np.uint64) << np.uint64(52)
    cut = np.flatnonzero(np.r_[True, part[new][1:] != part[new][:-1]])
    last = np.r_[cut[1:], len(new)]
    zero = np.zeros(len(cut), dtype=np.int64)
    i, j = walk(values, np.stack([cut, last, cut, last, zero], axis=1), 0, 1)
    own = np.flatnonzero(end - new > 1)
    return new, end, np.r_[i, own], np.r_[j, own]


def _member_pairs(new: np.ndarray, end: np.ndarray, i: np.ndarray, j: np.ndarray):
    """Pairs of members of the groups i and j, about PAIRS at a time."""
    n = (end - new)[i] * (end - new)[j]
    block = np.cumsum(n) // PAIRS
    for k in np.unique(block).tolist():
        x, y, m = i[block == k], j[block == k], n[block == k]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        wide = np.repeat((end - new)[y], m)
        p, q = np.repeat(new[x], m) + at // wide, np.repeat(new[y], m) + at % wide
        yield p[p != q], q[p != q]


def _block_links(part: np.ndarray, rest: np.ndarray, sketches: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forest links (row, row, bits) among rows sorted by (part, rest): pairs of one part whose rest differs in one bit at most.

    The forest joins what all candidates join; ``_open_pairs`` gives the others where the exact check refuses a link.
    """
    new, end, i, j = _near_groups(part, rest)
    n = (end - new)[i] * (end - new)[j]
    u, v = [], []
    for x, y in zip(i[n > PAIRS].tolist(), j[n > PAIRS].tolist(), strict=True):
        members = np.unique(np.r_[new[x]:end[x], new[y]:end[y]])
        p, q = linked_group(sketches[members], most)
        u.append(members[p])
        v.append(members[q])
    for p, q in _member_pairs(new, end, i[n <= PAIRS], j[n <= PAIRS]):
        near = _apart(sketches[p], sketches[q]) <= most
        u.append(p[near])
        v.append(q[near])
    u, v = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (u, v))
    d = _apart(sketches[u], sketches[v])
    kept = shortest_forest(len(part), u, v, d)
    return u[kept], v[kept], d[kept]


def _open_pairs(part: np.ndarray, rest: np.ndarray, sketches: np.ndarray, roots: np.ndarray, most: int):
    """All candidates (row, row) among rows sorted by (part, rest) whose roots differ, in pieces of bounded size."""
    new, end, i, j = _near_groups(part, rest)
    n = (end - new)[i] * (end - new)[j]
    for x, y in zip(i[n > PAIRS].tolist(), j[n > PAIRS].tolist(), strict=True):
        others = np.arange(new[y], end[y])
        if (roots[others] == roots[new[x]]).all() and (roots[new[x]:end[x]] == roots[new[x]]).all():
            continue
        for p in range(new[x], end[x]):
            q = others[others > p] if x == y else others
            q = q[roots[q] != roots[p]]
            for lo in range(0, len(q), PAIRS):
                near = q[lo:lo + PAIRS]
                near = near[_apart(sketches[near], sketches[p]) <= most]
                if len(near):
                    yield np.full(len(near), p), near
    for p, q in _member_pairs(new, end, i[n <= PAIRS], j[n <= PAIRS]):
        p, q = p[roots[p] != roots[q]], q[roots[p] != roots[q]]
        near = _apart(sketches[p], sketches[q]) <= most
        yield p[near], q[near]


def _links(dealt: DataFrame, most: int) -> DataFrame:
    """(u, v): the forests of the blocks, or where the rows have roots all candidates between different ones."""
    rooted = "root" in dealt.columns

    def run(batches):
        held, size = [], 0

        def out(rows):
            key = rows.column("key").to_numpy()
            part = rows.column("part").to_numpy() * 2**31 + rows.column("tile").to_numpy()
            rest, sketches = rows.column("rest").to_numpy(), _words(rows.column("sketch"))
            found = _open_pairs(part, rest, sketches, rows.column("root").to_numpy(), most) if rooted else [_block_links(part, rest, sketches, most)[:2]]
            for u, v in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[u], key[v])), pa.array(np.maximum(key[u], key[v]))], names=["u", "v"])

        def joined():
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size >= BLOCK_ROWS:
                rows = joined()
                part, tile = rows.column("part").to_numpy(), rows.column("tile").to_numpy()
                other = np.flatnonzero((part != part[-1]) | (tile != tile[-1]))
                end = int(other[-1]) + 1 if len(other) else 0  # the last part may go on in the next batch
                if end:
                    yield from out(rows.slice(0, end))
                held, size = [rows.slice(end)], len(rows) - end
        if size:
            yield from out(joined())

    rows = dealt.repartition("part", "tile").sortWithinPartitions("part", "tile", "rest", "key")
    return rows.select("part", "tile", "rest", "key", "sketch", *(["root"] if rooted else [])).mapInArrow(run, "u long, v long")


def _tiled(dealt: DataFrame) -> DataFrame:
    """The rows with a tile: 0, but where a part has more than PART_ROWS rows one for each pair of blocks that the row is in."""
    large = stored(dealt.groupBy("part").count().where(F.col("count") > PART_ROWS)
                   .select("part", F.ceil(2 * F.col("count") / PART_ROWS).cast("int").alias("blocks")), "large")
    if large.isEmpty():
        return dealt.withColumn("tile", F.lit(0))
    rows = salted_join(dealt, large, ["part"], ["key"], "left")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    tile = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, own) * F.col("blocks") + F.greatest(o, own))
    return rows.withColumn("tile", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(tile))).drop("blocks")


def _wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the texts whose key is wanted."""
    def keys(batches):
        seen: set[int] = set()  # copies leave a task once, so a hot text is not gathered row by row
        for batch in batches:
            own = [text_key(t.as_py()) for t in batch.column(0)]
            first = [i for i, k in enumerate(own) if k not in seen and not seen.add(k)]
            at = pa.array(first, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()).take(at), batch.column(0).take(at)], names=["key", "text"])

    texts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(keys, "key long, text string")
    # equal texts under one key differ in case and white space at most
    return texts.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))


def _with_text(links: DataFrame, texts: DataFrame, side: str, other: str, name: str) -> DataFrame:
    """Links with the text of one side; a text goes to one task for each LINKS of its links."""
    tasks = links.groupBy(F.col(side).alias("key")).agg(F.ceil(F.count("*") / LINKS).cast("int").alias("tasks"))
    left = links.join(tasks.withColumnRenamed("key", side), side).withColumn("task", F.pmod(F.xxhash64(other), F.col("tasks")).cast("int")).drop("tasks")
    right = texts.join(tasks, "key").select(F.col("key").alias(side), F.col("text").alias(name), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    return left.join(right, [side, "task"]).drop("task")


def checked_links(docs: DataFrame, links: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The links (u, v) whose texts' shingle sets are as similar as asked.

    Texts travel, not their sets: eight bytes a shingle that no codec makes smaller are more than the text.
    """
    def run(batches):
        held: dict[int, np.ndarray] = {}  # the joins bring the links of a text one after another

        def set_of(key, text):
            if key not in held:
                if len(held) >= SETS:
                    held.pop(next(iter(held)))
                held[key] = shingle_set(text, shingle)
            return held[key]

        for batch in batches:
            kept = []
            for i, (u, v, a, b) in enumerate(zip(*(batch.column(c) for c in ("u", "v", "a", "b")), strict=True)):
                x, y = set_of(u.as_py(), a.as_py()), set_of(v.as_py(), b.as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared >= similarity * (len(x) + len(y) - shared):
                    kept.append(i)
            yield batch.select(["u", "v"]).take(pa.array(kept, pa.int64()))

    wanted = links.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    texts = stored(_wanted_texts(docs, wanted), "wanted-texts")
    both = _with_text(_with_text(links, texts, "u", "v", "a"), texts, "v", "u", "b")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _open_links(docs: DataFrame, nodes: DataFrame, links: DataFrame, held: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links that hold beside those of the forest: candidates between texts that *held* leaves apart, in the groups where the check refused one of *links*."""
    refused = stored(links.join(held, ["u", "v"], "left_anti"), "refused")
    if refused.isEmpty():
        return held.limit(0)
    whole = stored(components(links), "candidate-groups")
    doubtful = whole.join(refused.select(F.col("u").alias("node")).distinct(), "node").select("root").distinct()
    among = whole.join(doubtful, "root", "left_semi").select(F.col("node").alias("key"))
    roots = components(held).withColumnRenamed("node", "key")
    rooted = nodes.join(among, "key", "left_semi").join(roots, "key", "left").select("key", "sketch", F.coalesce("root", "key").alias("root"))
    more = _links(_tiled(_dealt(stored(rooted, "rooted"))), budget(similarity)).distinct()
    return checked_links(docs, stored(more.join(refused, ["u", "v"], "left_anti"), "more-links"), shingle, similarity)


def near_texts(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (least doc_id over chains of links) per row."""
    prints = stored(_sketches(docs, shingle), "sketches")
    nodes = stored(prints.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("sketch").alias("sketch")), "texts")
    dealt = _tiled(_dealt(nodes))
    links = stored(_links(dealt, budget(similarity)).distinct(), "links")
    held = stored(checked_links(docs, links, shingle, similarity), "held")
    held = held.unionByName(_open_links(docs, nodes, links, held, shingle, similarity))
    groups = components(held)
    named = nodes.join(groups.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = stored(named, "members")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = stored(salted_join(named, least, ["root"], ["key"]).select("key", "component_id"), "ids")
    return salted_join(prints.select("doc_id", "key"), ids, ["key"], ["doc_id"]).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of *docs* that stay when one document of each component does: that with the least doc_id.

    Rows that repeat this doc_id stay with it; rows without a doc_id stay only in a component that has none.
    """
    found = near_texts(docs, shingle, similarity).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("keep")).distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(found, F.col("id").eqNullSafe(F.col("keep")), "left_semi").select("doc.*")
