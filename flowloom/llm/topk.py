"""Exact top-k search by inner product as a Voronoi kNN join.

Inner products become distances: with Phi the largest norm, a vector x gets one
more coordinate sqrt(Phi^2 - |x|^2) and a query a zero, and then
|q - x|^2 = |q|^2 + Phi^2 - 2 q.x, so the nearest are those of highest score.

1. Equal vectors are one point with the k + 1 smallest ids of its rows: no other
   row of it can be among the k best of any query.  Equal queries are one query.
2. Pivots (a hash sample, at most MAX_PIVOTS) part the space into Voronoi cells;
   points and queries go to their nearest pivot.
3. Summaries per cell: points and their k + 1 smallest pivot distances; queries
   and their largest pivot distance U.  From them the driver derives a bound theta
   per cell: by the triangle inequality every query of cell i has k + 1 points
   within U_i + |p_i - p_j| + d, taken over the smallest summaries of all cells.
4. Neighbouring query cells form groups of bounded size; a cell with more
   queries is split by hash.  A point is replicated to the groups one of
   whose cells it can serve: |x - p_i| <= U_i + theta_i.  Within a group points
   are dealt over slots of bounded size by hash, and the queries visit every slot.
5. Each slot is solved alone, points of near cells first: a cell is skipped for
   the queries whose k-th best is nearer than the cell can be.  Scores are
   exact integers.  The slots' best are merged, the query's own row is left out.

Bounds carry a slack against rounding, so pruning never decides; the summaries
on the driver grow with the pivots only.

Defined results: vectors that are null, hold null, NaN or infinite components or
one of magnitude 2**26 and more after scaling take no part, nor do rows without
id.  Vectors of several lengths count as filled up with zeros; one without
components scores zero with all.  Rows that agree in id and vector are one row;
an id with several vectors is several rows, each a candidate of the others.
Ties go to the smaller id.  A query with fewer candidates gets all.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import salted_join, stored

#: Pivots at most: what is broadcast and summarised is bounded by it.
MAX_PIVOTS = 1024
#: Queries of a group and points of a slot, about; a slot holds one scores block of them.
GROUP_QUERIES = 2048
SLOT_POINTS = 16384
#: Slots of a group at least, so that a small table is shared out, too.
LEAST_SLOTS = 16
#: Points whose scores are computed at once.
CHUNK = 2048
LARGEST = float(2**26)
SLACK = 1e-6

_TILE = "group int, slot int, query boolean, h1 long, h2 long, ids array<long>, cell int, dist double, x array<int>"
_BEST = "h1 long, h2 long, c1 long, c2 long, id long, score long"


def integer_rows(vectors: DataFrame, queries: Column, scale: int, key: str, vector: str) -> DataFrame:
    """(id, query, x, h1, h2): the rows that take part, each once; h1 and h2 identify the vector."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)))
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST / scale))
    rows = (vectors.where(F.col(key).isNotNull() & F.coalesce(usable, F.lit(False)))
            .select(F.col(key).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("query"), scaled.cast("array<int>").alias("x")).distinct())
    return rows.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), F.size("x"), "x")})


@dataclass
class _Space:
    """Pivots with their extra coordinate, and the square of the largest norm."""

    pivots: np.ndarray
    phi2: float

    def lift(self, x: np.ndarray, query: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.phi2 - np.einsum("ij,ij->i", x, x), 0))
        return np.column_stack([x, np.where(query, 0.0, extra)])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        square = np.einsum("ij,ij->i", lifted, lifted)[:, None] + np.einsum("ij,ij->i", self.pivots, self.pivots)[None] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _assign(points: DataFrame, space: _Space) -> DataFrame:
    """Cell and pivot distance of points and queries."""
    width = space.pivots.shape[1] - 1

    def work(batches):
        for batch in batches:
            d = space.distances(space.lift(_dense(batch.column("x"), width), batch.column("query").to_numpy(zero_copy_only=False)))
            cell = d.argmin(axis=1) if len(d) else np.zeros(0, dtype=int)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "dist"])

    return points.mapInArrow(work, "query boolean, h1 long, h2 long, ids array<long>, x array<int>, cell int, dist double")


@dataclass
class _Groups:
    """Which group serves which query cell, and how far its cells reach."""

    first: dict[int, int]  # cell -> its (first) group
    parts: dict[int, int]  # cell -> groups its queries are split over
    reach: np.ndarray  # cells: U + theta, -1 where there is no query
    theta: np.ndarray
    count: int
    slots: int


def _bounds(nearest: dict[int, list[float]], queries: dict[int, tuple[int, float]], space: _Space, k: int, points: int) -> _Groups:
    """Per-cell distance bounds from the summaries, and the groups of query cells."""
    n = len(space.pivots)
    between = space.distances(space.pivots)
    summary = [(j, d) for j, ds in nearest.items() for d in ds]
    cells, near = np.array([j for j, _ in summary], dtype=int), np.array([d for _, d in summary])
    theta, reach = np.full(n, np.inf), np.full(n, -1.0)
    for i, (_, far) in queries.items():
        if len(near) > k:
            theta[i] = np.partition(far + between[i, cells] + near, k)[k] * (1 + SLACK) + SLACK
        reach[i] = (far + theta[i]) * (1 + SLACK) + SLACK
    first, parts, groups, filled = {}, {}, 0, GROUP_QUERIES
    open_ = set(queries)
    at = min(open_, default=None)
    while open_:  # a chain from cell to nearest cell, cut into groups
        open_.remove(at)
        size = queries[at][0]
        parts[at] = math.ceil(size / GROUP_QUERIES)
        if parts[at] > 1 or filled + size > GROUP_QUERIES:
            first[at], filled = groups, size if parts[at] == 1 else GROUP_QUERIES
            groups += parts[at]
        else:
            first[at], filled = groups - 1, filled + size
        left = np.fromiter(open_, dtype=int)
        at = int(left[between[at, left].argmin()]) if len(left) else None
    return _Groups(first, parts, reach, theta, groups, max(LEAST_SLOTS, math.ceil(points / SLOT_POINTS)))


def _tiles(assigned: DataFrame, space: _Space, groups: _Groups) -> DataFrame:
    """Points to every group that may need them, queries to every slot of their group."""
    width = space.pivots.shape[1] - 1
    cells = np.array(sorted(groups.first), dtype=int)
    spans = [(groups.first[c], groups.first[c] + groups.parts[c]) for c in cells.tolist()]

    def work(batches):
        for batch in batches:
            query = batch.column("query").to_numpy(zero_copy_only=False)
            h1, h2, cell = (batch.column(c).to_numpy() for c in ("h1", "h2", "cell"))
            points = np.flatnonzero(~query)
            needed = np.zeros((len(points), groups.count), dtype=bool)
            if len(points):
                x = _dense(batch.column("x").take(pa.array(points)), width)
                serves = space.distances(space.lift(x, np.zeros(len(points), dtype=bool)))[:, cells] <= groups.reach[cells]
                for c, (a, b) in enumerate(spans):
                    needed[:, a:b] |= serves[:, c, None]
            p, g = np.nonzero(needed)
            asks = np.flatnonzero(query)
            own = np.array([groups.first[c] + h % groups.parts[c] for c, h in zip(cell[asks].tolist(), h1[asks].tolist(), strict=True)], dtype=np.int64)
            rows = np.concatenate([points[p], np.repeat(asks, groups.slots)])
            group = np.concatenate([g, np.repeat(own, groups.slots)]).astype(np.int32)
            slot = np.concatenate([h2[points[p]] % groups.slots, np.tile(np.arange(groups.slots), len(asks))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group), pa.array(slot), *[batch.column(c).take(pa.array(rows)) for c in ("query", "h1", "h2", "ids", "cell", "dist", "x")]],
                names=["group", "slot", "query", "h1", "h2", "ids", "cell", "dist", "x"])

    return assigned.mapInArrow(work, _TILE)


def _least(asked: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -score, asked))
    a = asked[order]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=int)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
    return order[rank < k]


def _solver(space: _Space, theta: np.ndarray, k: int):
    width = space.pivots.shape[1] - 1

    def solve(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        column = lambda name: tile.column(name).combine_chunks()
        query = column("query").to_numpy(zero_copy_only=False)
        x = _dense(column("x"), width)
        asks, points = np.flatnonzero(query), np.flatnonzero(~query)
        q = x[asks]
        reach = space.distances(space.lift(q, np.ones(len(q), dtype=bool)))
        base = np.einsum("ij,ij->i", q, q) + space.phi2
        kth = theta[column("cell").to_numpy()[asks]].copy()
        cell, dist = column("cell").to_numpy()[points], column("dist").to_numpy()[points]
        far = np.full(len(space.pivots), -np.inf)
        np.maximum.at(far, cell, dist)
        # the least distance that a point of a cell can have to any of the queries decides the order
        floor = (reach - far[None]).min(axis=0) if len(q) else far
        points = points[np.argsort(floor[cell], kind="stable")]
        cell = column("cell").to_numpy()[points]
        ids, exact = column("ids"), float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width < 2**53
        best = np.zeros((4, 0), dtype=np.int64)  # query, point, id, score
        for a in range(0, len(points) if len(q) else 0, CHUNK):
            part = points[a:a + CHUNK]
            there = np.unique(cell[a:a + CHUNK])
            active = np.flatnonzero(((reach[:, there] - far[there]) * (1 - SLACK) - SLACK <= kth[:, None]).any(axis=1))
            if not len(active):
                continue
            score = (q[active] @ x[part].T).astype(np.int64) if exact else q[active].astype(np.int64) @ x[part].T.astype(np.int64)
            if len(part) > k:
                at, to = np.nonzero(score >= np.partition(score, len(part) - k, axis=1)[:, len(part) - k, None])
            else:
                at, to = (m.ravel() for m in np.indices(score.shape))
            lists = ids.take(pa.array(part[to]))
            each = np.repeat(np.arange(len(to)), lists.value_lengths().to_numpy(zero_copy_only=False))
            new = np.stack([active[at][each], part[to][each], lists.flatten().to_numpy(), score[at, to][each]])
            best = np.concatenate([best, new], axis=1)
            best = best[:, _least(best[0], best[3], best[2], k)]
            asked, last = np.unique(best[0][::-1], return_index=True)
            last = best.shape[1] - 1 - last
            full = np.bincount(best[0], minlength=len(q))[asked] == k
            near = np.sqrt(np.maximum(base[asked] - 2.0 * best[3][last], 0)) * (1 + SLACK) + SLACK
            kth[asked[full]] = np.minimum(kth[asked], near)[full]
        h1, h2 = column("h1"), column("h2")
        row, point = pa.array(asks[best[0]]), pa.array(best[1])
        return pa.Table.from_arrays(
            [h1.take(row), h2.take(row), h1.take(point), h2.take(point), pa.array(best[2]), pa.array(best[3])], names=["h1", "h2", "c1", "c2", "id", "score"])

    return solve


def search(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of every row for which *queries* holds.

    The score is the inner product of the vectors' integers floor(scale * component); the candidates are all rows but the query's own.
    *pivots* defaults to the root of the number of distinct vectors, at most MAX_PIVOTS.
    """
    spark = vectors.sparkSession
    rows = stored(integer_rows(vectors, queries, scale, key, vector), "topk-rows")
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    points = (rows.select("h1", "h2", "id", "x", place.alias("r")).where(F.col("r") <= k + 1)
              .groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("x").alias("x")))
    asks = rows.where("query").select("h1", "h2", "x").distinct()
    square = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v.cast("long"))
    both = stored(points.select(F.lit(False).alias("query"), "h1", "h2", "ids", "x", square.alias("square"))
                  .unionByName(asks.select(F.lit(True).alias("query"), "h1", "h2", F.lit(None).cast("array<long>").alias("ids"), "x", square.alias("square"))), "topk-points")
    total = both.where("not query").agg(F.count("*").alias("n"), F.max("square").alias("phi2"), F.max(F.size("x")).alias("width")).first()
    if not total["n"]:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    count = min(MAX_PIVOTS, pivots or math.isqrt(total["n"]) + 1)
    chosen = both.where("not query").select("x", F.xxhash64("h1", F.lit(5)).alias("o"), "h1", "h2").orderBy("o", "h1", "h2").limit(count).collect()
    pivot = np.zeros((len(chosen), total["width"]))
    for i, r in enumerate(chosen):
        pivot[i, :len(r["x"])] = r["x"]
    space = _Space(np.zeros((0, 0)), float(total["phi2"]))
    space.pivots = space.lift(pivot, np.zeros(len(pivot), dtype=bool))

    assigned = stored(_assign(both.drop("square"), space), "topk-cells")
    close = F.row_number().over(Window.partitionBy("cell").orderBy("dist"))
    nearest: dict[int, list[float]] = {}
    for r in assigned.where("not query").select("cell", "dist", close.alias("r")).where(F.col("r") <= k + 1).collect():
        nearest.setdefault(r["cell"], []).append(r["dist"])
    asked = {r["cell"]: (r["n"], r["far"]) for r in assigned.where("query").groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect()}
    groups = _bounds(nearest, asked, space, k, total["n"])
    solved = _tiles(assigned, space, groups).groupBy("group", "slot").applyInArrow(_solver(space, groups.theta, k + 1), _BEST)
    merged = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id", "c1", "c2"))
    best = solved.withColumn("r", merged).where(F.col("r") <= k + 1).drop("r")
    found = salted_join(rows.where("query").select(F.col("id").alias("query_id"), "h1", "h2"), best, ["h1", "h2"], ["query_id"])
    rank = F.row_number().over(Window.partitionBy("query_id", "h1", "h2").orderBy(F.desc("score"), "id", "c1", "c2"))
    own = (F.col("id") == F.col("query_id")) & (F.col("c1") == F.col("h1")) & (F.col("c2") == F.col("h2"))
    return found.where(~own).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
