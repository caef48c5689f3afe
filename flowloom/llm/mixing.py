"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are aggregated by membership
pattern; the flow network has an arc from each pattern to each of its sources and
sends the sources' token quotas through the patterns' capacities.  Repeats cost
more the more often a pattern is passed (a convex cost: one arc a pass, each
dearer than the last), so the mix repeats as little as it can.  Each pattern's
tokens then become documents: whole passes for all of them, and for the rest the
documents with the smallest seeded hash, up to a cut found by histograms.

Rows: a null text has size 0; a null source is a source of its own, sorted last;
rows of size 0 are taken 0 times; rows that repeat a doc_id are mixed apart and
share the fate of their hash as far as the cut allows; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import SPACES, row_key, stored

MAX_PASSES = 3
WEIGHTS = (1, 2, 3)
#: Patterns and arcs solved on the driver: a pattern is one aggregate row, never a document.
MAX_PATTERNS = 100_000
SEED = "mix-1"
#: Two hexadecimal digits of the hash for each histogram level: 256 bins, then 256 in the bin that the cut falls into, and so on.
LEVELS = 3
#: Documents that may fill, one after another, what the cut leaves over of a pattern's rest.
FILLS = 3


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: int = MAX_PASSES) -> dict[str | None, float]:
    """Each source's share of all tokens by repeating weights, stopped at *most* times its size, the excess dealt again by weight."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))  # str order is code point order
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = float(sum(size.values())), list(size), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = float(most * size[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(capacity: dict, members: dict, quota: dict, most: int = MAX_PASSES) -> dict:
    """Tokens of each pattern for each of its sources: {(pattern, source): tokens}.

    Successive shortest paths with potentials over pass arcs of rising cost.
    *capacity*: tokens of a pattern; *members*: its sources; *quota*: tokens that a source wants.
    """
    graph: list[list[int]] = [[] for _ in range(2 + len(capacity) + len(quota))]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(a, b, cap, price):
        for x, y, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)

    patterns, sources = list(capacity), list(quota)
    at_pattern = {p: 2 + i for i, p in enumerate(patterns)}
    at_source = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    between = {}
    for p in patterns:
        for turn in range(most):
            arc(0, at_pattern[p], capacity[p], turn * turn)  # convex: the first pass is free, each next one dearer
        for s in members[p]:
            between[p, s] = len(to)
            arc(at_pattern[p], at_source[s], most * capacity[p], 0)
    for s in sources:
        arc(at_source[s], 1, quota[s], 0)
    potential = [0] * len(graph)
    while True:
        far: list[float] = [float("inf")] * len(graph)
        came = [-1] * len(graph)
        far[0] = 0
        heap = [(0, 0)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e] > 0 and (n := d + cost[e] + potential[x] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], came[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if far[1] == float("inf"):
            break
        top = max(f for f in far if f != float("inf"))
        potential = [p + (f if f != float("inf") else top) for p, f in zip(potential, far)]
        path, x = [], 1
        while x:
            path.append(came[x])
            x = to[came[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return {k: room[e ^ 1] for k, e in between.items()}


def select_by_hash(docs: DataFrame, rest: DataFrame) -> DataFrame:
    """*docs* (pattern, doc_id, row, size, hash) with ``extra``: the first by hash whose sizes stay within the pattern's ``rest``, and one that fills what is left.

    The cut is found by histograms of the hash's digits: each level sums the sizes
    in the bin that the cut falls into, so nothing is sorted but at most 256 bins
    a pattern, and at last the few documents that share the leading digits.
    """
    bins = rest.select("pattern", F.lit("").alias("lead"), F.col("rest").cast("long").alias("left"))
    for level in range(1, LEVELS + 1):
        here = docs.where("size > 0").join(F.broadcast(bins), "pattern").where(F.substring("hash", 1, 2 * level - 2) == F.col("lead"))
        sums = here.groupBy("pattern", F.substring("hash", 1, 2 * level).alias("bin"), "left").agg(F.sum("size").alias("size"))
        before = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        # the bin in which the running size passes what is left; patterns whose whole rest is taken have none
        cut = sums.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("size")))
        bins = stored(cut.select("pattern", F.col("bin").alias("lead"), (F.col("left") - F.col("before")).alias("left")), "cut")
    width = 2 * LEVELS
    last = docs.where("size > 0").join(F.broadcast(bins), "pattern").where(F.substring("hash", 1, width) == F.col("lead"))
    run = Window.partitionBy("pattern").orderBy("hash", "row")
    inside = last.withColumn("end", F.sum("size").over(run)).where("end <= left")
    edge = inside.groupBy("pattern").agg(F.max(F.struct("hash", "row")).alias("edge"))
    limits = rest.select("pattern", "rest").join(bins.select("pattern", "lead"), "pattern", "left").join(edge, "pattern", "left")
    lead = F.substring("hash", 1, width)
    under = F.when(F.col("lead").isNull(), F.lit(True)).otherwise(
        (lead < F.col("lead")) | ((lead == F.col("lead")) & F.coalesce(F.struct("hash", "row") <= F.col("edge"), F.lit(False))))
    out = docs.join(F.broadcast(limits), "pattern", "left")
    out = stored(out.withColumn("extra", F.coalesce((F.col("rest") > 0) & under, F.lit(False))).drop("lead", "edge"), "chosen")
    # what the cut leaves over goes to the document whose size comes nearest to it, ties by hash; then what that leaves, and so on
    for _ in range(FILLS):
        over = out.groupBy("pattern").agg((F.max("rest") - F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))).alias("over")).where("over > 0")
        off = F.abs(F.col("size") - F.col("over"))
        fill = (out.where(~F.col("extra") & (F.col("size") > 0)).join(F.broadcast(over), "pattern").where(off < F.col("over"))
                .groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "hash", "row", "doc_id")).alias("fill")))
        fill = stored(fill.select("pattern", F.col("fill.row").alias("fill_row"), F.col("fill.doc_id").alias("fill_doc")), "fill")
        out = out.join(F.broadcast(fill), "pattern", "left")
        chosen = F.coalesce((F.col("row") == F.col("fill_row")) & F.col("doc_id").eqNullSafe(F.col("fill_doc")), F.lit(False))
        out = out.withColumn("extra", F.col("extra") | chosen).drop("fill_row", "fill_doc")
    return out.drop("rest")


def mix(docs: DataFrame, sources: Column | None = None, weights=WEIGHTS, most: int = MAX_PASSES, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """Per row of *docs*: doc_id, row (its content key), size, pattern, source_size, target and taken (words taken, repeats counted).

    *sources*: an array of a document's sources; by default the one in ``source``.
    source_size and target are sums over the pattern's sources.
    """
    member = F.array(F.col("source").cast("string")) if sources is None else F.array_sort(F.array_distinct(sources))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "source", "text").alias("row"), member.alias("pattern"), size_of(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), row_key("doc_id", "source", "text").cast("string")))).alias("hash"))
    sized = stored(sized, "sizes")
    found = sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; merge small sources first")
    capacity = {tuple(r["pattern"]): r["size"] for r in found}
    size: dict = {}
    for p, n in capacity.items():
        for s in p:
            size[s] = size.get(s, 0) + n
    all_tokens = sum(capacity.values())
    if any(len(p) > 1 for p in capacity):  # shares of the tokens there are, as overlapping sources count them more than once
        scale = all_tokens / max(1, sum(size.values()))
    else:
        scale = 1.0
    target = {s: t * scale for s, t in targets(list(size.items()), weights, most).items()}
    flow = min_cost_flow(capacity, {p: list(p) for p in capacity}, {s: round(t) for s, t in target.items()}, most)
    plan = []
    for p, n in capacity.items():
        tokens = sum(flow.get((p, s), 0) for s in p)
        passes = min(most, tokens // n) if n else 0
        plan.append((list(p), int(sum(size[s] for s in p)), float(sum(target[s] for s in p)), int(passes), int(tokens - passes * n)))
    spark = docs.sparkSession
    plans = spark.createDataFrame(plan, "pattern array<string>, source_size long, target double, passes long, rest long")
    # null is no join key: patterns meet by their place in the plan
    key = F.to_json(F.struct("pattern"), {"ignoreNullFields": "false"})
    keyed = sized.withColumn("members", F.col("pattern")).withColumn("pattern", key)
    plans = plans.withColumn("pattern", key)
    chosen = select_by_hash(keyed, plans.select("pattern", "rest"))
    out = chosen.join(F.broadcast(plans.drop("rest")), "pattern")
    times = F.col("passes") + F.when(F.col("extra") & (F.col("passes") < most), 1).otherwise(0)
    return out.select("doc_id", "row", "size", F.col("members").alias("pattern"), "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of *docs* that the mix takes, each as often as it is taken."""
    picks = mix(docs, **options).where("taken > 0").select("row", F.col("doc_id").alias("id"), (F.col("taken") / F.col("size")).cast("int").alias("times"))
    picks = picks.groupBy("row", "id").agg(F.max("times").alias("times"))
    # the document's columns travel in one struct, where no name of theirs can meet one of ours
    keyed = docs.select(F.struct("*").alias("doc"), row_key("doc_id", "source", "text").alias("key"), F.col("doc_id").cast("long").alias("own"))
    joined = keyed.join(picks, (F.col("key") == F.col("row")) & F.col("own").eqNullSafe(F.col("id")))
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
