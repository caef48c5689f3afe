"""Embedding near-duplicates by NN-descent.

Equal vectors of a label are one node with a count.  Neighbour lists start from
orderings by random-projection codes: along each ordering, overlapping windows
of fixed size offer each other as neighbours.  Then lists are refined: every node
introduces the members of its list, and those that list it, to one another;
better neighbours replace worse ones until few lists change.  A node whose whole
list lies above the threshold is saturated; its list is enlarged to its connected
component, compared in blocks.  Recall is audited on a bounded query set against
all vectors, per vector and by number of links, and more orderings are added while
it is too low; if it stays so, all pairs of each label are compared in blocks.

Vectors compare only within one label and one length, by cosine in double
precision.  Rows: a null label, or a vector that is null, empty, zero or holds a
null or non-finite component, links with nothing; rows that repeat a vector are
each other's links; component_id is the least vec_id reached (null when a
component has none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import components, salted_join, stored
from flowloom.llm.simhash import forest

THRESHOLD = 0.93
LIST = 10
#: Orderings of the first and of each further round.
ORDERINGS = 12
WINDOW, STEP = 64, 32
#: Rounds of refinement end when less than this share of list places changes.
CHANGED = 0.02
MAX_REFINEMENTS = 4
#: Side of the blocks in which a saturated node meets its component, and the members of a hot centre one another.
BLOCK = 256
#: Side of the blocks in which all pairs are compared when the audit has not passed.
EXACT_BLOCK = 1024
#: Queries of each power of two of the number of links, and the share of them whose links must all be found.
AUDIT_QUERIES = 512
AUDIT_RECALL = 0.98
MAX_ROUNDS = 3
ROWS = 20_000
#: Hot centres that are broadcast; more are joined like any other table.
FEW_HOT = 10_000


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _units(column):
    """A function from bounds to the unit vectors of those rows; rows of one length are made ready at once."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(set(np.diff(column.offsets.to_numpy()).tolist())) == 1:
        whole = _unit(_matrix(column))
        return lambda lo, hi: whole[lo:hi]
    return lambda lo, hi: _unit(_matrix(column.slice(lo, hi - lo)))


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal keys."""
    n = len(keys[0])
    if not n:
        return []
    change = np.zeros(n - 1, dtype=bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    cuts = (np.flatnonzero(change) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n]))


def _edges(u, v, s) -> pa.RecordBatch:
    cat = (lambda x, t: np.concatenate(x) if x else np.empty(0, dtype=t))
    return pa.RecordBatch.from_arrays([pa.array(cat(u, np.int64)), pa.array(cat(v, np.int64)), pa.array(cat(s, np.float64))], names=["u", "v", "s"])


def _whole_runs(batches, n_keys: int, longest: int):
    """Tables of about ROWS rows made of whole runs of the first *n_keys* columns; a run longer than *longest* is given out in parts."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = [t.column(i).to_numpy() for i in range(n_keys)]
            end = _runs(*keys)[-1][0]
            if end == 0 and size >= longest:
                end = size
            if end:
                yield t.slice(0, end)
            held = t.slice(end).to_batches()
            size -= end
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _merged(one: DataFrame) -> DataFrame:
    """*one*, a row a node, told to be merged: a broadcast of it would grow with the table on the driver."""
    return one.hint("merge")


def _can_link() -> Column:
    value = F.col("embedding")
    return F.coalesce(
        F.col("label").isNotNull() & value.isNotNull() & (F.size(value) > 0)
        & F.forall(value, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
        & F.exists(value, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))


def nodes_of(vectors: DataFrame) -> DataFrame:
    """node (hash of label and vector), grp (hash of label and length), vec, least vec_id, rows; only of vectors that can link."""
    rows = vectors.where(_can_link()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").alias("vec"))
    return (rows.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("rows"))
            .select(F.xxhash64("label", "vec").alias("node"), F.xxhash64("label", F.size("vec")).alias("grp"), "vec", "least", "rows"))


def _ordered_neighbours(nodes: DataFrame, orderings: range) -> DataFrame:
    """Neighbours in windows along each ordering: (u, v, s)."""
    kind = dict(nodes.dtypes)["vec"]

    def code(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(2)])
            for dim in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                unit = _unit(_matrix(part.column(2)))
                for turn in orderings:
                    planes = np.random.default_rng(1000 + turn).normal(size=(dim, 40))
                    codes = ((unit @ planes) > 0) @ (1 << np.arange(39, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), turn)), part.column(1), pa.array(codes), part.column(0), part.column(2)],
                                                     names=["turn", "grp", "code", "node", "vec"])

    def meet(batches):
        for t in _whole_runs(batches, 2, 4 * ROWS):
            turn, grp, node = (t.column(i).to_numpy() for i in (0, 1, 3))
            us, vs, ss = [], [], []
            units = _units(t.column(4))
            for lo, hi in _runs(turn, grp):
                unit = units(lo, hi)
                for a in range(0, max(1, hi - lo - STEP), STEP):
                    part, names = unit[a:a + WINDOW], node[lo + a:min(hi, lo + a + WINDOW)]
                    if len(names) > 1:
                        u, v, s = _best(part @ part.T, LIST)
                        us.append(names[u])
                        vs.append(names[v])
                        ss.append(s)
            yield _edges(us, vs, ss)

    coded = nodes.select("node", "grp", "vec").mapInArrow(code, f"turn long, grp long, code long, node long, vec {kind}")
    dealt = coded.repartitionByRange("turn", "grp", "code", "node").sortWithinPartitions("turn", "grp", "code", "node")
    return dealt.mapInArrow(meet, "u long, v long, s double")


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the k largest entries of each row beside the diagonal."""
    np.fill_diagonal(sims, -2)
    return _largest(sims, min(k, len(sims) - 1))


def _largest(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the k largest entries of each row."""
    n, k = len(sims), min(k, sims.shape[1])
    if not n or not k:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    cols = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(n), k)
    cols = cols.ravel()
    return rows, cols, sims[rows, cols]


def _lists(edges: DataFrame) -> DataFrame:
    """The LIST best distinct neighbours of each node, ties by the neighbour."""
    def top(batches):
        for t in _whole_runs(batches, 1, 1 << 60):  # a node's offers are at most a few windows', never a group's
            u, v, s = (t.column(i).to_numpy() for i in range(3))
            order = np.lexsort((v, u))
            same = np.zeros(len(u), dtype=bool)
            same[1:] = (u[order][1:] == u[order][:-1]) & (v[order][1:] == v[order][:-1])
            first = np.sort(order[~same])
            u, v, s = u[first], v[first], s[first]
            order = np.lexsort((v, -s, u))
            u, v, s = u[order], v[order], s[order]
            starts = np.array([lo for lo, _ in _runs(u)] or [0])
            rank = np.arange(len(u)) - np.repeat(starts, np.diff([*starts.tolist(), len(u)])) if len(u) else np.empty(0)
            keep = rank < LIST
            yield _edges([u[keep]], [v[keep]], [s[keep]])
    return edges.repartition("u").sortWithinPartitions("u").mapInArrow(top, "u long, v long, s double")


def _block_pairs(members: DataFrame) -> DataFrame:
    """Each row goes to the pairs (a, b), a <= b, that its own one of *columns* blocks makes, so every two members of a key meet in one pair."""
    out = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("columns")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    return out.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other", "columns")


def _introduce(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Better neighbours that the members of each node's surroundings are to one another: (u, v, s)."""
    worst = lists.groupBy("u").agg(F.min("s").alias("worst"), F.count("*").alias("n")).select(
        F.col("u").alias("node"), F.when(F.col("n") >= LIST, F.col("worst")).otherwise(-2.0).alias("worst"))
    around = stored(lists.select(F.col("u").alias("centre"), F.col("v").alias("node"))
                    .unionByName(lists.select(F.col("v").alias("centre"), F.col("u").alias("node")))
                    .distinct().unionByName(nodes.select(F.col("node").alias("centre"), "node")), "around")
    # a centre that many list is hot: its members are dealt as block pairs, any other's go to one task
    hot = around.groupBy("centre").count().where(F.col("count") > BLOCK).select("centre", F.ceil(F.col("count") / BLOCK).cast("int").alias("columns"))
    hot = stored(hot, "hot")
    dealt = around.join(F.broadcast(hot), "centre", "left") if hot.count() <= FEW_HOT else salted_join(around, hot, ["centre"], ["node"], "left", wide=True)
    pairs = _block_pairs(dealt.withColumn("columns", F.coalesce("columns", F.lit(1))))
    known = nodes.select("node", "vec").join(_merged(worst), "node", "left").select("node", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "vec")
    full = salted_join(pairs, known, ["node"], ["centre"], wide=True).select("centre", "a", "b", "own", "node", "worst", "vec")

    def meet(batches):
        for t in _whole_runs(batches, 3, 1 << 60):  # a block pair has about 2 * BLOCK rows
            centre, a, b, own, node, worst_ = (t.column(i).to_numpy() for i in range(6))
            unit = _units(t.column(6))
            us, vs, ss = [], [], []
            for lo, hi in _runs(centre, a, b):
                part, names, least = unit(lo, hi), node[lo:hi], worst_[lo:hi]
                if a[lo] == b[lo]:
                    found = [_best(part @ part.T, LIST)] if hi - lo > 1 else []
                else:
                    mid = int((own[lo:hi] == a[lo]).sum())
                    sims = part[:mid] @ part[mid:].T
                    (u, v, s), (x, y, z) = _largest(sims, LIST), _largest(sims.T, LIST)
                    found = [(u, mid + v, s), (mid + x, y, z)]
                for u, v, s in found:
                    better = s > least[u] + 1e-12
                    us.append(names[u[better]])
                    vs.append(names[v[better]])
                    ss.append(s[better])
            yield _edges(us, vs, ss)

    met = full.repartition("centre", "a", "b").sortWithinPartitions("centre", "a", "b", "own", "node")
    return met.mapInArrow(meet, "u long, v long, s double")


def neighbour_lists(nodes: DataFrame, orderings: range, lists: DataFrame | None = None) -> DataFrame:
    """Lists (u, v, s) after the given orderings and refinement to convergence."""
    offers = _ordered_neighbours(nodes, orderings)
    lists = stored(_lists(offers if lists is None else offers.unionByName(lists)), "lists")
    places = max(1, lists.count())
    for _ in range(MAX_REFINEMENTS):
        better = stored(_introduce(lists, nodes).distinct(), "better")
        changed = better.count()
        if changed:
            lists = stored(_lists(lists.unionByName(better)), "lists")
        if changed < CHANGED * places:
            break
    return lists


def _enlarged(nodes: DataFrame, roots: DataFrame, saturated: DataFrame, threshold: float) -> DataFrame:
    """Links of saturated nodes to their whole component, compared in blocks: rows (u, v, n_nodes, n_rows).

    v is null in the sums of a saturated node u; rows with v are the single links to nodes u that are not saturated.
    """
    member = roots.join(_merged(saturated.select(F.col("u").alias("node"), F.lit(True).alias("full"))), "node", "left")
    sizes = member.groupBy("root").agg(F.count("*").alias("n"), F.count("full").alias("m")).where("m > 0")
    member = salted_join(member, sizes, ["root"], ["node"], wide=True).withColumn("full", F.coalesce("full", F.lit(False)))
    member = member.join(nodes, "node").select(
        "root", "node", "full", "rows", "vec", F.ceil(F.col("n") / BLOCK).cast("int").alias("columns"), F.ceil(F.col("m") / BLOCK).cast("int").alias("across"))
    h = F.xxhash64("node")
    ask = member.where("full").withColumn("a", F.pmod(h, F.col("across")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    give = member.withColumn("b", F.pmod(h, F.col("columns")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    shape = ["root", "a", "b", "side", "node", "full", "rows", "vec"]
    both = ask.withColumn("side", F.lit(0)).select(*shape).unionByName(give.withColumn("side", F.lit(1)).select(*shape))
    dealt = both.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "side", "node")

    def meet(batches):
        for t in _whole_runs(batches, 3, 1 << 60):  # a block pair has about 2 * BLOCK rows
            root, a, b, side, node, rows = (t.column(i).to_numpy() for i in (0, 1, 2, 3, 4, 6))
            full = t.column(5).to_numpy(zero_copy_only=False)
            unit = _units(t.column(7))
            out: list[list[np.ndarray]] = [[], [], [], []]
            for lo, hi in _runs(root, a, b):
                mid = lo + int((side[lo:hi] == 0).sum())
                if mid == lo or mid == hi:
                    continue
                near = (unit(lo, mid) @ unit(mid, hi).T >= threshold) & (node[lo:mid, None] != node[None, mid:hi])
                out[0].append(node[lo:mid])
                out[1].append(np.full(mid - lo, np.iinfo(np.int64).min))
                out[2].append(near.sum(axis=1))
                out[3].append(near @ rows[mid:hi])
                i, j = np.nonzero(near & ~full[None, mid:hi].astype(bool))
                out[0].append(node[mid + j])
                out[1].append(node[lo + i])
                out[2].append(np.ones(len(i), dtype=np.int64))
                out[3].append(rows[lo + i])
            cols = [np.concatenate(c).astype(np.int64) if c else np.empty(0, dtype=np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["u", "v", "n_nodes", "n_rows"])

    out = dealt.mapInArrow(meet, "u long, v long, n_nodes long, n_rows long")
    return out.withColumn("v", F.when(F.col("v") != F.lit(-(1 << 63)), F.col("v")))


def _counts(nodes: DataFrame, lists: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, n_nodes, n_rows) of every node with links, and (node, root)."""
    links = stored(lists.where(F.col("s") >= threshold).select("u", "v"), "links")
    roots = stored(components(links, wide=True), "roots")
    saturated = stored(links.groupBy("u").count().where(F.col("count") >= LIST).select("u"), "saturated")
    more = stored(_enlarged(nodes, roots, saturated, threshold), "more")
    weight = nodes.select(F.col("node").alias("v"), "rows")
    single = (links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(_merged(saturated), "u", "left_anti")
              .unionByName(more.where("v is not null").select("u", "v")).distinct())
    single = salted_join(single, weight, ["v"], ["u"], wide=True).groupBy("u").agg(F.count("*").alias("n_nodes"), F.sum("rows").alias("n_rows"))
    summed = more.where("v is null").groupBy("u").agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_rows").alias("n_rows"))
    return single.unionByName(summed).withColumnRenamed("u", "node"), roots


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, queries: int = AUDIT_QUERIES) -> float:
    """The least, over sizes, of the share of vectors whose true links the counts hold in full; a size is a power of two of the number of links.

    Each query is compared with all vectors.  Queries are a bounded set of each size as found, and stand for the vectors of that size, so
    neither a large cluster nor the vectors without a link hide what is missed in small groups.
    """
    size = F.floor(F.log2(F.coalesce("n_nodes", F.lit(0)) + 1)).cast("int")
    sized = stored(nodes.select("node").join(_merged(counts.select("node", "n_nodes")), "node", "left").select("node", F.coalesce("n_nodes", F.lit(0)).alias("found"), size.alias("size")), "sized")
    order = F.xxhash64("node", F.lit(3))
    picked = sized.groupBy("size", F.pmod(order, F.lit(queries)).alias("slot")).agg(F.min_by(F.struct("node", "found"), order).alias("q"), F.count("*").alias("n"))
    picked = stored(picked.select("size", "q.node", "q.found", "n"), "picked")
    got = nodes.join(F.broadcast(picked.select("node")), "node").select("node", "grp", "vec").collect()
    if not got:
        return 1.0
    groups: dict = {}
    for r in got:
        groups.setdefault(r["grp"], []).append(r)
    asked = {g: (np.array([r["node"] for r in rs]), _unit(np.array([r["vec"] for r in rs], dtype=np.float64))) for g, rs in groups.items()}
    shared = nodes.sparkSession.sparkContext.broadcast(asked)  # at most *queries* vectors for each power of two

    def run(batches):
        for batch in batches:
            grp, node = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for g in np.unique(grp).tolist():
                if g not in shared.value:
                    continue
                at = np.flatnonzero(grp == g)
                names, unit = shared.value[g]
                true = np.zeros(len(names), dtype=np.int64)
                for lo in range(0, len(at), 1024):
                    part = at[lo:lo + 1024]
                    near = (unit @ _unit(_matrix(batch.column(2).take(pa.array(part)))).T >= threshold) & (names[:, None] != node[part][None])
                    true += near.sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(true)], names=["node", "true"])

    true = nodes.select("node", "grp", "vec").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    weight = picked.groupBy("size").agg((F.sum("n") / F.count("*")).alias("weight"))
    judged = picked.join(weight, "size").join(true, "node").where(F.col("true") > 0).groupBy(F.floor(F.log2("true")).alias("true_size")).agg(
        (F.sum(F.when(F.col("found") >= F.col("true"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("share"))
    least = judged.agg(F.min("share")).first()[0]
    return 1.0 if least is None else least


def _exact(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """What _counts gives, from all pairs of each label and length in blocks; tasks emit sums and a forest of their links, not pairs."""
    sizes = nodes.groupBy("grp").agg(F.ceil(F.count("*") / EXACT_BLOCK).cast("int").alias("columns"))
    pairs = _block_pairs(salted_join(nodes.select("node", "grp", "rows", "vec"), sizes, ["grp"], ["node"])).select("grp", "a", "b", "own", "node", "rows", "vec")

    def meet(batches):
        for t in _whole_runs(batches, 3, 1 << 60):  # a block pair has about 2 * EXACT_BLOCK rows
            grp, a, b, own, node, rows = (t.column(i).to_numpy() for i in range(6))
            unit = _units(t.column(6))
            for lo, hi in _runs(grp, a, b):
                part, names, weight = unit(lo, hi), node[lo:hi], rows[lo:hi]
                mid = 0 if a[lo] == b[lo] else int((own[lo:hi] == a[lo]).sum())
                left = slice(0, mid or hi - lo)
                near = part[left] @ part[mid:].T >= threshold
                if not mid and a[lo] == b[lo]:
                    np.fill_diagonal(near, False)
                    n_nodes, n_rows = near.sum(axis=1), near @ weight
                elif mid:
                    n_nodes = np.concatenate([near.sum(axis=1), near.sum(axis=0)])
                    n_rows = np.concatenate([near @ weight[mid:], weight[:mid] @ near])
                else:
                    continue  # one of the blocks is empty
                i, j = np.nonzero(near)
                root = forest(len(names), i, mid + j)
                some, tied = np.flatnonzero(n_nodes), np.flatnonzero(root != np.arange(len(names)))
                none = np.full(len(some), np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (
                    (names[some], names[tied]), (none, names[root[tied]]), (n_nodes[some], tied * 0), (n_rows[some], tied * 0))], names=["u", "v", "n_nodes", "n_rows"])

    dealt = pairs.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b", "own", "node")
    out = stored(dealt.mapInArrow(meet, "u long, v long, n_nodes long, n_rows long"), "exact")
    summed = F.col("v") == F.lit(-(1 << 63))
    counts = out.where(summed).groupBy("u").agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_rows").alias("n_rows")).withColumnRenamed("u", "node")
    return counts, stored(components(out.where(~summed).select("u", "v"), wide=True), "roots")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of *vectors* (vec_id, embedding, label)."""
    nodes = stored(nodes_of(vectors), "nodes")
    lists, counts, roots = None, None, None
    for turn in range(MAX_ROUNDS):
        lists = neighbour_lists(nodes, range(turn * ORDERINGS, (turn + 1) * ORDERINGS), lists)
        counts, roots = _counts(nodes, lists, threshold)
        counts = stored(counts, "counts")
        if audit(nodes, counts, threshold) >= AUDIT_RECALL:
            break
    else:
        counts, roots = _exact(nodes, threshold)
        counts = stored(counts, "counts")
    joined = nodes.select("node", "least", "rows").join(_merged(roots), "node", "left").join(_merged(counts), "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("n_rows", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    joined = stored(joined, "joined")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(salted_join(joined, least, ["root"], ["node"], wide=True).select("node", "n_links", "component_id"), "named")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(_can_link(), F.xxhash64("label", "embedding")).alias("node"))
    found = salted_join(rows, named.withColumn("linked", F.lit(True)), ["node"], ["vec_id"], "left", wide=True)
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                        F.col("vec_id").eqNullSafe(component).alias("kept"))
