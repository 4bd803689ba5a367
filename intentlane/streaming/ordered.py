"""A fold over a key's rows in event-time order, however they arrive.

Rows are held in state until the watermark passes them; an event-time timer at
the earliest held row wakes the key, its due rows are sorted by time and id
and given to the fold once, so the result is that of the batch job over
the same rows. A row that arrives at or behind the watermark cannot
be folded in order any more: it leaves at once with ``late`` true, and the sink
writes such rows to a side output instead of losing them.

A key's rows are appended to list state as they come, one element of column
arrays per Arrow batch; only what is held for one key, the rows of one watermark
delay, is read back together. The fold names a horizon at which its state needs
another look; when the watermark passes it, the fold drops the state or says
what has come due."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from intentlane.session import ship_package

#: (key, due rows in order, state or None, watermark) -> (output frame or None, new state or None, horizon); times in microseconds.
#: A key whose horizon the watermark has passed is folded once more, without rows.
Fold = Callable[[tuple, pd.DataFrame, tuple | None, int], tuple[pd.DataFrame | None, tuple | None, int]]


def _arrays(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema])


class OrderedFold(StatefulProcessor):
    def __init__(self, fold: Fold, held: T.StructType, state: T.StructType, out: list[str], time_col: str, id_col: str,
                 late: Callable[[tuple, pd.DataFrame], pd.DataFrame]):
        self.fold, self.held_schema, self.state_schema, self.out = fold, _arrays(held), state, out
        self.names = held.fieldNames()
        self.order = [time_col, id_col]
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)
        self.state = handle.getValueState("state", self.state_schema)
        # earliest held time and the horizon of the state, both in microseconds; -1: none
        self.wake = handle.getValueState("wake", "earliest bigint, horizon bigint")

    def _register(self, t_us: int) -> None:
        # one millisecond past the row: the timer fires when the watermark has passed it
        self.handle.registerTimer(t_us // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wm_us = timerValues.getCurrentWatermarkInMs() * 1000
        earliest, horizon = self.wake.get() or (-1, -1)
        first = earliest
        for pdf in rows:
            behind = pdf[self.order[0]] <= wm_us if wm_us > 0 else pd.Series(False, index=pdf.index)
            if behind.any():
                yield self.late(key, pdf[behind]).assign(late=True)[self.out]
                pdf = pdf[~behind]
            if len(pdf):
                self.held.appendValue(tuple(_plain(pdf[n]) for n in self.names))
                least = int(pdf[self.order[0]].min())
                earliest = least if earliest < 0 else min(earliest, least)
        if earliest != first:
            self._register(earliest)
            self.wake.update((earliest, horizon))

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        wm_us = timerValues.getCurrentWatermarkInMs() * 1000
        earliest, horizon = self.wake.get() or (-1, -1)
        if 0 <= earliest < wm_us or 0 <= horizon < wm_us:
            held = [list(chain.from_iterable(c)) for c in zip(*self.held.get())] or [[] for _ in self.names]
            pdf = pd.DataFrame({n: c for n, c in zip(self.names, held)})
            ready = pdf[self.order[0]] < wm_us
            rest = pdf[~ready]
            if len(rest):
                self.held.put([tuple(_plain(rest[n]) for n in self.names)])
            else:
                self.held.clear()
            pdf = pdf[ready].sort_values(self.order, kind="mergesort", ignore_index=True)
            before = self.state.get()
            out, state, horizon = self.fold(key, pdf, before, wm_us)
            if out is not None and len(out):
                yield out.assign(late=False)[self.out]
            if state is not None and horizon < wm_us and len(pdf):
                # the watermark has passed the horizon too: no need to wake again for it
                out, state, horizon = self.fold(key, pdf.iloc[:0], state, wm_us)
                if out is not None and len(out):
                    yield out.assign(late=False)[self.out]
            if state is not None:
                self.state.update(state)
                self._register(horizon)
            else:
                horizon = -1
                if before is not None:
                    self.state.clear()
            earliest = int(rest[self.order[0]].min()) if len(rest) else -1
            if earliest >= 0:
                self._register(earliest)
            if earliest < 0 and state is None:
                self.wake.clear()
            else:
                self.wake.update((earliest, horizon))

    def close(self) -> None:
        pass


def _plain(column: pd.Series) -> list:
    """Python values, with None for missing ones. Integer columns must hold no
    nulls: pandas would make them floats."""
    return [None if v is None or v != v else v for v in column.tolist()]


def ordered_fold(events: DataFrame, key: str, held: T.StructType, state: T.StructType, out: T.StructType, fold: Fold,
                 late: Callable[[tuple, pd.DataFrame], pd.DataFrame], watermark: str, time_col: str = "t_us",
                 id_col: str = "event_id", keep: Column | None = None) -> DataFrame:
    """``out`` plus ``late`` for a stream of (key, held columns). Rows without
    a time have no place in the order and are left out (normalisation rejects
    them), rows without an id come first in their instant; other held columns
    are text or doubles if they can be null. Only rows that ``keep`` holds for
    are folded. The watermark is taken over all rows; the stateful operator does not see the event-time
    column itself, so it gets late rows too instead of never hearing of them."""
    ship_package(events.sparkSession)
    names = held.fieldNames()
    src = events.where(F.col(time_col).isNotNull()).withColumn(id_col, F.coalesce(id_col, F.lit(-1)))
    src = src.select(key, *names).withColumn("_ts", F.timestamp_micros(time_col)).withWatermark("_ts", watermark)
    if keep is not None:
        # rows that are not kept still move the watermark: the (never true) test
        # of the event time keeps the optimizer from filtering below it
        src = src.where(keep | F.col("_ts").isNull())
    src = src.select(key, *names)
    schema = T.StructType([*out.fields, T.StructField("late", T.BooleanType())])
    processor = OrderedFold(fold, held, state, schema.fieldNames(), time_col, id_col, late)
    return src.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="append", timeMode="EventTime")


def write_with_side_output(df: DataFrame, path: str, checkpoint: str):
    """A stream writer that puts on-time rows under ``path/main`` and late ones
    under ``path/late``, by micro-batch; a batch that is run again replaces its files."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for late, name in ((False, "main"), (True, "late")):
                (batch.where(F.col("late") == late).drop("late").write.mode("overwrite")
                 .parquet(f"{path}/{name}/batch={batch_id}"))
        finally:
            batch.unpersist()
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_side_output(spark, path: str, name: str, schema: T.StructType) -> DataFrame:
    fields = [f for f in schema.fields if f.name != "late"]
    return spark.read.schema(T.StructType(fields)).parquet(f"{path}/{name}/batch=*")
