"""Keyed stateful streams that take rows in event-time order, whatever order they arrive in.

Arriving rows are kept in the key's map state as sorted runs, cut into blocks,
until the watermark has passed them; an event-time timer then merges the runs
up to the watermark, a block of each in memory at a time, and hands the rows one
by one to a step function with the key's memory.  So a task's memory doesn't
grow with the rows that wait under a key, and a row is written and read once.
Rows that come later than the watermark allows are dropped by Spark.  The step
says when its memory ends, and a timer removes it then, so a key that falls
silent leaves no state behind.

State lives in RocksDB, which the map and timer states need.
"""

from __future__ import annotations

import heapq
import itertools
import json
import pickle
from collections import namedtuple
from collections.abc import Callable, Generator, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: Time of the mark that ends a stream: it moves the watermark past every row and every limit.
END_US = 253_402_300_799_000_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that are sorted at once, rows of a run that are read at once, and rows that leave a task at once.
RUN_ROWS = 20_000
BLOCK_ROWS = 250
OUT_ROWS = 5_000

#: step(key, memory, rows, mark) yields output rows and returns (memory or None, time in microseconds at which the memory ends or None).
#: ``mark`` is the watermark: every row up to it is handed over.
Step = Callable[[tuple, dict | None, Iterator, int], Generator[tuple, None, tuple[dict | None, int | None]]]

# pandas knows no missing number or truth: such cells travel as 0, and masks of MASK columns say which are missing
_ZEROS = {T.ByteType: 0, T.ShortType: 0, T.IntegerType: 0, T.LongType: 0, T.FloatType: 0.0, T.DoubleType: 0.0, T.BooleanType: False}
_MASK = 60


class _InOrder(StatefulProcessor):
    def __init__(self, names: list[str], zeros: list[int], keys: list[str], order: list[str], step: Step, out: list[str]) -> None:
        self.names, self.zeros, self.step, self.out = names, zeros, step, out
        self.keys = [names.index(c) for c in keys]
        self.at, self.order = names.index("_at"), [names.index(c) for c in order]

    def init(self, handle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "run long, block long", "rows binary")
        self.info = handle.getValueState("info", "info string")

    def _loaded(self) -> dict:
        """``key``, ``memory``, ``timer`` and ``runs``: [number, next block, blocks, time of the next row]."""
        return json.loads(self.info.get()[0]) if self.info.exists() else {"key": None, "memory": None, "timer": None, "next": 0, "runs": []}

    def _keep(self, info: dict) -> None:
        if info["runs"] or info["memory"] is not None or info["timer"] is not None:
            self.info.update((json.dumps(info, default=int),))
        elif self.info.exists():
            self.info.clear()

    def _wake(self, info: dict, us: int | None) -> None:
        """Keep one timer, for the earliest of the times asked for."""
        now, at = info["timer"], None if us is None else us // 1000 + 1
        if at is None or (now is not None and now <= at):
            return
        if now is not None:
            self.handle.deleteTimer(now)
        self.handle.registerTimer(at)
        info["timer"] = at

    def _sort_key(self, row: tuple) -> list:
        return [row[self.at], *[(row[i] is not None, row[i]) for i in self.order]]

    def _tuples(self, pdf: pd.DataFrame) -> Iterator[tuple]:
        """The rows as plain values, missing ones as None."""
        cells = [pdf[f"c{i}"].tolist() for i in range(len(self.names))]
        for n, lo in enumerate(range(0, len(self.zeros), _MASK)):
            masks = pdf[f"missing{n}"].tolist()
            if any(masks):
                for bit, i in enumerate(self.zeros[lo:lo + _MASK]):
                    cells[i] = [None if m >> bit & 1 else v for m, v in zip(masks, cells[i])]
        return zip(*cells)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        info = self._loaded()
        new = itertools.chain.from_iterable(map(self._tuples, rows))
        while held := list(itertools.islice(new, RUN_ROWS)):
            held.sort(key=self._sort_key)
            if info["key"] is None:
                info["key"] = [held[0][i] for i in self.keys]
            run, first = info["next"], held[0][self.at]
            for n, lo in enumerate(range(0, len(held), BLOCK_ROWS)):
                self.blocks.updateValue((run, n), (pickle.dumps(held[lo:lo + BLOCK_ROWS], 5),))
            info["runs"].append([run, 0, -(-len(held) // BLOCK_ROWS), first])
            info["next"] = run + 1
            self._wake(info, first)
        self._keep(info)
        return iter(())

    def _due(self, run: list, mark: int) -> Iterator[tuple]:
        """Rows of a run up to *mark*; what is left of it stays, and the run's entry tells where it goes on."""
        number, block, blocks, _ = run
        while block < blocks:
            rows = pickle.loads(self.blocks.getValue((number, block))[0])
            for n, row in enumerate(rows):
                if row[self.at] > mark:
                    if n:
                        self.blocks.updateValue((number, block), (pickle.dumps(rows[n:], 5),))
                    run[1:] = [block, blocks, row[self.at]]
                    return
                yield row
            self.blocks.removeKey((number, block))
            block += 1
        run[1] = blocks

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        info = self._loaded()
        info["timer"] = None
        named = namedtuple("Arrived", self.names, rename=True)._make
        due = heapq.merge(*[self._due(r, mark) for r in info["runs"] if r[3] <= mark], key=self._sort_key)
        ended = {}

        def made():
            ended["memory"], ended["at"] = yield from self.step(tuple(info["key"]), info["memory"], map(named, due), mark)

        rows = made()
        while out := list(itertools.islice(rows, OUT_ROWS)):
            yield pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(self.out, zip(*out))})
        info["memory"], ends = ended["memory"], ended["at"]
        info["runs"] = [r for r in info["runs"] if r[1] < r[2]]
        wake = [r[3] for r in info["runs"]] + ([max(ends, mark)] if info["memory"] is not None and ends is not None else [])
        self._wake(info, min(wake, default=None))
        self._keep(info)

    def close(self) -> None:
        pass


def in_event_order(
    df: DataFrame, keys: list[str], at: Column, order: list[str], step: Step, out_schema: T.StructType | str, late: str, keep: Column | None = None,
) -> DataFrame:
    """Run *step* over each key's rows in order of time (*at*, microseconds) and then of *order*.

    *keep* chooses the rows that reach the operator; the others still move the watermark.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    if isinstance(out_schema, str):
        out_schema = T._parse_datatype_string(out_schema)
    timed = df.withColumn("_at", at).withColumn("_event", F.timestamp_micros("_at")).withWatermark("_event", late)
    wanted = F.col("_at") < END_US if keep is None else (F.col("_at") < END_US) & keep
    # one condition that reads the event time, so that the optimizer leaves it above the watermark
    rows = timed.filter(F.when(F.col("_event").isNotNull(), F.coalesce(wanted, F.lit(False))).otherwise(False))
    fields = [f for f in rows.schema.fields if f.name != "_event"]
    names = [f.name for f in fields]
    zeros = [i for i, f in enumerate(fields) if type(f.dataType) in _ZEROS]
    bit = lambda n, i: F.shiftleft(F.col(names[i]).isNull().cast("long"), n)
    masks = [sum((bit(n, i) for n, i in enumerate(zeros[lo:lo + _MASK])), F.lit(0).cast("long")).alias(f"missing{lo // _MASK}")
             for lo in range(0, len(zeros), _MASK)]
    filled = [F.coalesce(F.col(f.name), F.lit(_ZEROS[type(f.dataType)]).cast(f.dataType)) if i in zeros else F.col(f.name) for i, f in enumerate(fields)]
    # pandas rows keep no name that begins with an underscore
    sent = rows.select(F.to_json(F.struct(*keys)).alias("key"), *[c.alias(f"c{i}") for i, c in enumerate(filled)], F.col("_event").alias("event"), *masks)
    processor = _InOrder(names, zeros, keys, order, step, [f.name for f in out_schema.fields])
    return sent.groupBy("key").transformWithStateInPandas(processor, out_schema, "append", "EventTime")


def close_input(spark: SparkSession, path: str, schema: T.StructType, time_column: str, scale: int = 1) -> None:
    """End the file stream in folder *path*: one more file, with a row that is null but for its time.

    *scale*: how many microseconds a unit of the time column is.  Everything that
    waits is then handed over and every limit has passed; rows that are added
    afterwards are late.
    """
    kind = schema[time_column].dataType
    mark = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    value = float(END_US // scale) if isinstance(kind, (T.DoubleType, T.FloatType)) else END_US // scale
    row = spark.createDataFrame([tuple(value if f.name == time_column else None for f in mark.fields)], mark)
    row.coalesce(1).write.mode("append").parquet(path)
