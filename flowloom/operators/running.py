"""Ordered computations that must not put one key into one task.

``running_total``  cumulative sums: ordered chunks, chunk totals, offsets.
``cooldown_fires``  a rule that rests after each firing, as tables of slots that are composed.
``smallest_by_hash``, ``taken_by_hash``  the n rows of a group with the smallest hash, marked or alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from flowloom.operators.session import cut

#: Length of a slot of ``cooldown_fires`` in cool-downs, and slots whose tables are composed by one task.
SLOTS = 64
FAN = 256


def ordered_chunks(df: DataFrame, by: Sequence[str], chunks: int) -> DataFrame:
    """Range-partition by *by* and fix the partition number as ``_chunk``.

    Range partitioning balances on the full order, so a frequent key is
    spread over many chunks.  The result is materialised: partition bounds
    come from a sample and must not change between uses.
    """
    return cut(df.repartitionByRange(chunks, *by).withColumn("_chunk", F.spark_partition_id()))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], chunks: int | None = None) -> DataFrame:
    """Add cumulative sums (rows up to and including the current one) per *keys* in *order*.

    Two levels: sums inside a chunk, plus the totals of earlier chunks of the
    key.  *order* must be unique within the keys.
    """
    chunks = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    base = ordered_chunks(base, [*keys, *order], chunks)
    totals = base.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", *[
        F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = base.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(inside) for n in sums})
    # the offsets hold one row per key and chunk; Spark picks the join by their size
    joined = local.join(offsets, [*keys, "_chunk"])
    out = joined.withColumns({n: F.col(f"_s_{n}") + F.col(f"_o_{n}") for n in sums})
    return out.drop("_chunk", *[f"_{p}_{n}" for p in "vso" for n in sums])


def cooldown_fires(
    df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], cooldown: float, window: float, hits: Callable,
) -> DataFrame:
    """The rows at which a rule fires that rests for *cooldown* after each firing and forgets what was before: a fold, run in parallel.

    ``hits(pdf, first)`` takes rows in order and gives, for every start position p,
    the first position from *first* on at which the rule fires when it has seen the
    rows from p only (``len(pdf)``: none; one more entry for the end).  A firing at j
    may depend on rows up to *window* before it.

    All that the past says is when the rule may see rows again, and only the last
    *cooldown* and *window* before a place matter there.  So each key's time is cut
    into slots of SLOTS times their sum, one task a slot, and

    1. each slot states a table "wakes at" -> "wakes at after the slot", a row of
       two arrays no longer than the rows within *window* and *cooldown* of its start;
    2. FAN slots at a time, the tables are composed to one;
    3. the composed tables of a key are walked from the empty past, which gives each
       group's true start, and 4. the tables inside each group, each slot's;
    5. each slot emits its firings from its true start.

    That is one path for every size and a fixed number of jobs.  *order* must be
    unique within a key and time.  Rows without a time never fire.
    """
    keys, by, columns = list(keys), [at, *order], df.columns
    span, fan = SLOTS * (cooldown + window), FAN
    own = F.floor(F.col(at) / span).cast("long")
    ahead = (own + 1) * span - F.col(at) <= window  # the next slot sees the window before it
    base = cut(df.filter(F.col(at).isNotNull()).withColumn("_slot", F.explode(F.when(F.lit(window > 0) & ahead, F.array(own, own + 1)).otherwise(F.array(own)))))
    fields = {f.name: f for f in base.schema.fields}
    key_schema = [fields[k] for k in keys]
    tables_schema = T.StructType([*key_schema, T.StructField("_slot", T.LongType()), T.StructField("_upto", T.ArrayType(T.DoubleType())),
                                  T.StructField("_out", T.ArrayType(T.DoubleType()))])
    starts_schema = T.StructType([*key_schema, T.StructField("_slot", T.LongType()), T.StructField("_wakes", T.DoubleType())])

    def path(pdf):
        """Times, the position of the slot's first own row, and the next firing after each position's firing."""
        import numpy as np

        pdf = pdf.sort_values(by, kind="stable")
        t = pdf[at].to_numpy(dtype=float)
        start = float(pdf["_slot"].iloc[0]) * span
        first = int(np.searchsorted(t, start))
        hit = np.asarray(hits(pdf, first), dtype=np.int64)
        return pdf, t, start, hit, np.append(hit[np.searchsorted(t, t + cooldown)], len(t))

    def table(pdf):
        import numpy as np
        import pandas as pd

        pdf, t, start, hit, after = path(pdf)
        n = len(t)
        last = np.where(after == n, np.arange(n + 1), after)
        while (last[last] != last).any():
            last = last[last]
        p = np.arange(int(np.searchsorted(t, start + cooldown)) + 1)
        wakes = np.where(hit[p] == n, -np.inf, np.append(t, 0.0)[last[hit[p]]] + cooldown)
        upto = np.append(t, np.inf)[p]
        upto[-1] = np.inf
        stays = np.append(wakes[1:] != wakes[:-1], True)  # one entry for neighbours that end alike
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), int(pdf["_slot"].iloc[0]), upto[stays], wakes[stays]]], columns=[*keys, "_slot", "_upto", "_out"])

    def through(upto, out, wakes):
        import numpy as np

        return np.asarray(out)[np.searchsorted(np.asarray(upto), wakes)]

    def composed(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("_slot")
        wakes = np.asarray(pdf["_out"].iloc[0])
        for upto, out in zip(pdf["_upto"].iloc[1:], pdf["_out"].iloc[1:]):
            wakes = through(upto, out, wakes)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), int(pdf["_slot"].iloc[0]) // fan, pdf["_upto"].iloc[0], wakes]], columns=[*keys, "_slot", "_upto", "_out"])

    def walked(pdf):
        import numpy as np

        pdf = pdf.sort_values("_slot")
        wakes, found = float(pdf["_start"].iloc[0]) if "_start" in pdf else -np.inf, []
        for upto, out in zip(pdf["_upto"], pdf["_out"]):
            found.append(wakes)
            wakes = float(through(upto, out, wakes))
        return pdf[[*keys, "_slot"]].assign(_wakes=found)

    def emitted(rows, starts):
        pdf, t, _, hit, after = path(rows)
        import numpy as np

        i, picked = int(hit[np.searchsorted(t, float(starts["_wakes"].iloc[0]))]), []
        while i < len(t):
            picked.append(i)
            i = int(after[i])
        return pdf.iloc[picked][columns]

    tables = cut(base.groupBy(*keys, "_slot").applyInPandas(table, tables_schema))
    group = F.floor(F.col("_slot") / fan).cast("long")
    groups = tables.withColumn("_group", group).groupBy(*keys, "_group").applyInPandas(composed, tables_schema)
    first = groups.groupBy(*keys).applyInPandas(walked, starts_schema)
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    placed = tables.withColumn("_group", group).alias("t").join(
        first.select(*keys, F.col("_slot").alias("_g"), F.col("_wakes").alias("_start")).alias("g"),
        [*same, F.col("_group") == F.col("_g")]).select("t.*", "_start")
    starts = placed.groupBy(*keys, "_group").applyInPandas(walked, starts_schema)
    return base.groupBy(*keys, "_slot").cogroup(starts.groupBy(*keys, "_slot")).applyInPandas(emitted, df.schema)


def smallest_by_hash(df: DataFrame, group: str, row_hash: Column, quota: DataFrame, digits: int = 4, settled: bool = False) -> DataFrame:
    """Mark (``_picked``) the ``quota`` rows of each group with the smallest hash.

    *row_hash* is a hex string or a binary value that is unique per row, *digits*
    are the characters or bytes of its prefix; *quota* has columns
    (*group*, ``quota``).  Groups are counted per hash prefix, half its length
    first and the rest where the quota runs out; the rows of that prefix are ranked
    alone, and the rest is a comparison with one cut-off value per group: no group
    is ever sorted or shuffled as a whole.  *settled* reads the cut-off values now
    and puts them into the plan, for results that are read many times.
    """
    hashed = df.withColumn("_hash", row_hash)
    half = max(1, digits // 2)
    edge = _hash_edge(hashed, group, quota, half).collect()  # one row per group; groups are label classes, so this stays small
    here = F.substring("_hash", 1, half) == _by_group(df, group, {r[group]: r["_prefix"] for r in edge})
    near = cut(hashed.filter(here).select(group, "_hash"))
    rest = df.sparkSession.createDataFrame([(r[group], r["_take"]) for r in edge], near.select(group).schema.add("quota", "long"))
    last = _hash_cut(near, _hash_edge(near, group, rest, digits), group, digits)
    if settled:
        out, upto = hashed, _by_group(df, group, {r[group]: r["_cut"] for r in last.collect()})
    else:
        out, upto = hashed.join(F.broadcast(last), group, "left"), F.col("_cut")
    return out.withColumn("_picked", F.coalesce(F.col("_hash") <= upto, F.lit(False))).drop("_hash", "_cut")


def _by_group(df: DataFrame, group: str, values: dict) -> Column:
    """The entry of *values* for a row's *group*, else NULL."""
    kind = df.schema[group].dataType
    if not values:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k).cast(kind), F.lit(v))]), F.col(group))


def taken_by_hash(df: DataFrame, group: str, row_hash: Column, quota: DataFrame, digits: int = 4) -> DataFrame:
    """The rows that ``smallest_by_hash`` picks, alone: those up to the prefix in which the quota runs out are written once."""
    hashed = df.withColumn("_hash", row_hash)
    edge = cut(_hash_edge(hashed, group, quota, digits))
    upto = F.broadcast(edge.select(group, F.col("_prefix").alias("_last")))  # one row per group
    near = cut(hashed.join(upto, group).filter(F.substring("_hash", 1, digits) <= F.col("_last")).select(*hashed.columns))
    return near.join(F.broadcast(_hash_cut(near, edge, group, digits)), group).filter("_hash <= _cut").drop("_hash", "_cut")


def _hash_edge(hashed: DataFrame, group: str, quota: DataFrame, digits: int) -> DataFrame:
    """Per group the prefix in which its quota runs out and how many rows to take there."""
    sizes = hashed.groupBy(group, F.substring("_hash", 1, digits).alias("_prefix")).count()
    upto = W.partitionBy(group).orderBy("_prefix").rowsBetween(W.unboundedPreceding, 0)
    return (
        sizes.withColumn("_cum", F.sum("count").over(upto)).join(quota.select(group, "quota"), group)
        .filter("_cum >= quota and _cum - count < quota")
        .select(group, "_prefix", (F.col("quota") - F.col("_cum") + F.col("count")).alias("_take")))


def _hash_cut(hashed: DataFrame, edge: DataFrame, group: str, digits: int) -> DataFrame:
    """(group, ``_cut``): the greatest hash that is taken."""
    return (
        hashed.select(group, F.substring("_hash", 1, digits).alias("_prefix"), "_hash").join(F.broadcast(edge), [group, "_prefix"])  # one row per group
        .withColumn("_rank", F.row_number().over(W.partitionBy(group).orderBy("_hash")))
        .filter("_rank = _take").select(group, F.col("_hash").alias("_cut")))
