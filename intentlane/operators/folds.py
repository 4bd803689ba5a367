"""Output-dependent ordered folds (INT-3, GOV-3, GOV-4).

Greedy cooldown: per key, in (time, tie) order, the first candidate fires
and opens a lock of length C; candidates inside the lock are dropped and do
not extend it; the next fire is the first candidate at t >= last_fire + C.

One path for every size of key. A key's candidates are cut into chunks of
``chunk_cooldowns`` * C and every (key, chunk) is laid out on its own:

1. A chunk depends on the past only through the end of the lock it inherits,
   and whatever that is, its first fire is one of the rows in the chunk's
   first C, or the first row after them. For each of those entries the last
   fire of the chunk is followed forward; neighbouring entries with the same
   last fire are one step. The result is a short step function per chunk
   (chains of different entries merge after a few jumps).
2. The step functions of a key, in chunk order, give each chunk its inherited
   lock: only these steps meet in one task per key, streamed with one value
   of state.
3. Each chunk fires from its inherited lock on its own.

No task reads all rows of a key, nothing runs while the plan is built, and
the two passes over the candidates read the same shuffle.

Compound cap (GOV-4): the next send depends on the last ``max + 1`` sends, so
no short step function exists. A key is cut where it pauses for the longer of
the two periods, since no state survives such a pause; the stretches between
pauses fold in parallel, from send to send by binary search.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from intentlane.session import ship_package

#: width of a chunk in cooldowns: one step function per key and chunk
CHUNK_COOLDOWNS = 16


def _numpy(batch: pa.RecordBatch, col: str) -> np.ndarray:
    return batch.column(col).to_numpy(zero_copy_only=False)


def _runs(batch: pa.RecordBatch, cols: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(values, start, end) of each run of equal ``cols`` in an ordered batch."""
    n = batch.num_rows
    if n == 0:
        return
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in cols:
        v = _numpy(batch, c)
        # nulls form one key: an unequal pair of nulls is no change
        change[1:] |= (v[1:] != v[:-1]) & ~(pd.isna(v[1:]) & pd.isna(v[:-1]))
    starts = np.flatnonzero(change)
    heads = [batch.column(c).take(pa.array(starts)).to_pylist() for c in cols]
    yield from zip(zip(*heads), starts.tolist(), [*starts[1:].tolist(), n])


class _Chunks:
    """The runs of one ordered batch of candidates on a common time line: run
    i, counted from its chunk's start, begins at i * span, and span leaves a
    cooldown free behind every chunk, so a jump never lands in a later run."""

    def __init__(self, batch: pa.RecordBatch, group: list[str], t_col: str, width_us: int,
                 cooldown_us: int):
        runs = list(_runs(batch, group))
        self.groups = [values for values, _, _ in runs]
        self.first = np.array([s for _, s, _ in runs], dtype=np.int64)
        sizes = np.array([e - s for _, s, e in runs], dtype=np.int64)
        self.span, self.cooldown_us = width_us + cooldown_us, cooldown_us
        if len(runs) * self.span >= 2**62:
            raise ValueError("chunks too wide for a batch: lower chunk_cooldowns or the batch size")
        self.start = np.array([values[-1] * width_us for values in self.groups], dtype=np.int64)
        self.run = np.repeat(np.arange(len(runs)), sizes)
        self.line = self.at(self.run, _numpy(batch, t_col))

    def at(self, run, t):
        """Times ``t`` within their chunks, on the line."""
        return t - self.start[run] + run * self.span

    def next(self, run, fires):
        """(row, found): the first row of ``run`` a cooldown or more after ``fires``."""
        return self.first_from(run, fires + self.cooldown_us)

    def first_from(self, run, line):
        row = np.searchsorted(self.line, line, "left")
        found = row < len(self.line)
        found[found] = self.run[row[found]] == run[found]
        return row, found

    def last_fires(self, run, fires):
        out, live = fires.copy(), np.arange(len(fires))
        while len(live):
            row, found = self.next(run[live], out[live])
            live = live[found]
            out[live] = self.line[row[found]]
        return out


def _chunk_steps(laid: DataFrame, keys: list[str], t_col: str, cooldown_us: int,
                 width_us: int) -> DataFrame:
    """(keys, _chunk, _entry, _exit): a lock that ends after the previous
    _entry and at or before this one makes _exit the chunk's last fire."""
    group = [*keys, "_chunk"]
    schema = T.StructType([laid.schema[k] for k in keys] + [
        T.StructField(c, T.LongType()) for c in ("_chunk", "_entry", "_exit")])
    arrow = to_arrow_schema(schema)

    def rows(groups, run, entry, last):
        heads = [pa.array([g[i] for g in groups], type=arrow.field(i).type).take(pa.array(run))
                 for i in range(len(group))]
        return pa.RecordBatch.from_arrays([*heads, pa.array(entry), pa.array(last)], schema=arrow)

    def steps(batches):
        none = np.empty(0, dtype=np.int64)
        open_group, entry, last, past_head = None, none, none, False    # of the last run, still open
        for batch in batches:
            if batch.num_rows == 0:
                continue
            c = _Chunks(batch, group, t_col, width_us, cooldown_us)
            same = c.groups[0] == open_group
            if open_group is not None and not same:
                yield rows([open_group], np.zeros(len(entry), dtype=np.int64), entry, last)
            if not same:
                entry, last, past_head = none, none, False
            head = c.line - c.run * c.span < cooldown_us
            # the first row behind the head of each run is an entry as well
            tail_run, tail_row = np.unique(c.run[~head], return_index=True)
            tail_row = np.flatnonzero(~head)[tail_row]
            open_past = past_head
            past_head = (past_head and len(c.groups) == 1) or bool((tail_run == len(c.groups) - 1).any())
            take = head.copy()
            take[tail_row[1 if open_past and len(tail_run) and tail_run[0] == 0 else 0:]] = True
            run = np.concatenate([np.zeros(len(entry), dtype=np.int64), c.run[take]])
            new = c.line[take]
            fires = np.concatenate([c.at(np.zeros(len(last), dtype=np.int64), last), new])
            back = c.start[run] - run * c.span
            entry = np.concatenate([entry, new + back[len(entry):]])
            last = c.last_fires(run, fires) + back
            keep = np.append((run[1:] != run[:-1]) | (last[1:] != last[:-1]), True)
            run, entry, last = run[keep], entry[keep], last[keep]
            done = run < len(c.groups) - 1
            yield rows(c.groups, run[done], entry[done], last[done])
            open_group, entry, last = c.groups[-1], entry[~done], last[~done]
        if open_group is not None:
            yield rows([open_group], np.zeros(len(entry), dtype=np.int64), entry, last)

    return laid.mapInArrow(steps, schema=schema)


def _inherited_locks(steps: DataFrame, keys: list[str], cooldown_us: int) -> DataFrame:
    """(keys, _chunk, _from): the time from which each chunk may fire; chunks
    wholly inside a lock are left out."""
    schema = T.StructType([steps.schema[k] for k in keys] + [
        T.StructField(c, T.LongType()) for c in ("_chunk", "_from")])
    arrow = to_arrow_schema(schema)
    never = np.iinfo(np.int64).min

    def chain(batches):
        key, chunk, lock_end, fired = None, None, never, False
        for batch in batches:
            out = []
            for *row, entry, exit_ in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:-1] != key:
                    key, chunk, lock_end = row[:-1], None, never
                if row[-1] != chunk:
                    chunk, fired = row[-1], False
                if not fired and entry >= lock_end:
                    out.append((*row, lock_end))
                    lock_end, fired = exit_ + cooldown_us, True
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(
                zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow)

    return (steps.repartition(*keys).sortWithinPartitions(*keys, "_chunk", "_entry")
            .mapInArrow(chain, schema=schema))


def greedy_cooldown(cand: DataFrame, keys: list[str], t_col: str, tie_col: str,
                    cooldown_us: int, mark_col: str | None = None,
                    chunk_cooldowns: int = CHUNK_COOLDOWNS) -> DataFrame:
    """Rows of ``cand`` that fire under the greedy cooldown. ``tie_col`` must
    be unique within a key. ``mark_col``: keep every row and flag the fires in
    this boolean column (instead of returning the fires only)."""
    if cooldown_us <= 0:
        raise ValueError("cooldown_us must be positive")
    if chunk_cooldowns < 1:
        raise ValueError("chunk_cooldowns must be at least 1")
    ship_package(cand.sparkSession)
    width_us = chunk_cooldowns * cooldown_us
    group = [*keys, "_chunk"]
    # both passes use every column, so that they share this one shuffle
    laid = (cand.withColumn("_chunk", F.floor(F.col(t_col) / F.lit(width_us)).cast("long"))
            .repartition(*group))
    steps = _chunk_steps(laid.sortWithinPartitions(*group, t_col, tie_col), keys, t_col,
                         cooldown_us, width_us)
    locks = _inherited_locks(steps, keys, cooldown_us)
    # a chunk's lock travels to it as one more row, ahead of its candidates
    told = locks.withColumn(t_col, F.col("_from"))
    together = (laid.withColumn("_from", F.lit(None).cast("long"))
                .unionByName(told, allowMissingColumns=True))
    schema = T.StructType(cand.schema.fields + ([] if mark_col is None else
                                                [T.StructField(mark_col, T.BooleanType())]))

    def fire(batches):
        open_group, open_from = None, None      # of the last run, which the next batch may go on with
        for batch in batches:
            if batch.num_rows == 0:
                continue
            is_lock = batch.column("_from").is_valid().to_numpy(zero_copy_only=False)
            lock = batch.column("_from").fill_null(0).to_numpy()
            c = _Chunks(batch.set_column(batch.schema.get_field_index(t_col), t_col, pa.array(
                # a lock row takes the place of its chunk's start on the line
                np.where(is_lock, _numpy(batch, "_chunk") * width_us, _numpy(batch, t_col)))),
                group, t_col, width_us, cooldown_us)
            keep = np.zeros(batch.num_rows, dtype=bool)
            known = is_lock[c.first]
            start = lock[c.first]
            if c.groups[0] == open_group and open_from is not None and not known[0]:
                known[0], start[0] = True, open_from
            run = np.flatnonzero(known)
            free = np.clip(start[run], c.start[run], c.start[run] + width_us + cooldown_us - 1)
            row, found = c.first_from(run, c.at(run, free))
            # the lock row itself is no candidate
            row = np.where(found & is_lock[np.minimum(row, len(keep) - 1)], row + 1, row)
            found = found & (row < len(keep))
            found[found] = c.run[row[found]] == run[found]
            end = start.copy()
            while found.any():
                run, row = run[found], row[found]
                keep[row] = True
                end[run] = c.line[row] - run * c.span + c.start[run] + cooldown_us
                row, found = c.next(run, c.line[row])
            open_group, open_from = c.groups[-1], int(end[-1]) if known[-1] else None
            if mark_col is None:
                yield batch.filter(pa.array(keep)).select(schema.names)
            else:
                marked = batch.filter(pa.array(~is_lock)).select(schema.names[:-1])
                yield marked.append_column(mark_col, pa.array(keep[~is_lock]))

    return (together.repartition(*group)
            .sortWithinPartitions(*group, F.col("_from").isNull(), t_col, tie_col)
            .mapInArrow(fire, schema=schema))


def _stretches(req: DataFrame, keys: list[str], t_col: str, pause_us: int) -> DataFrame:
    """Add ``_stretch``: rows of a key between two pauses of ``pause_us`` share it.

    A pause of that length always crosses the edge of a bucket as wide, so the
    buckets' first and last times are enough to find every one of them."""
    bucketed = req.withColumn("_bucket", F.floor(F.col(t_col) / F.lit(pause_us)).cast("long"))
    order = Window.partitionBy(*keys).orderBy("_bucket")
    before = F.lag("_last").over(order)
    spans = (bucketed.groupBy(*keys, "_bucket").agg(F.min(t_col).alias("_first"), F.max(t_col).alias("_last"))
             .withColumn("_cut", (F.col("_first") - before >= F.lit(pause_us)).cast("long"))
             .withColumn("_stretch", F.sum(F.coalesce("_cut", F.lit(0))).over(order)))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_bucket"]]
    return (bucketed.alias("r").join(spans.alias("s"), on)
            .select("r.*", F.col("s._stretch").alias("_stretch")).drop("_bucket"))


def compound_cap(req: DataFrame, keys: list[str], t_col: str, tie_col: str,
                 gap_us: int, window_us: int, max_in_window: int,
                 strict_more_than: bool = True) -> DataFrame:
    """Add ``allowed``: a request becomes a send unless a send happened in
    (t - gap, t] or the sends in (t - window, t] are more than
    ``max_in_window`` (or at least, when ``strict_more_than`` is False)."""
    ship_package(req.sparkSession)
    out_schema = T.StructType(req.schema.fields + [T.StructField("allowed", T.BooleanType())])
    limit = max_in_window if strict_more_than else max_in_window - 1
    group = [*keys, "_stretch"]
    stretched = _stretches(req, keys, t_col, max(gap_us, window_us))

    def fold(batches):
        current, free_at = None, None
        sends: deque[int] = deque(maxlen=max(limit + 1, 1))
        for batch in batches:
            t = _numpy(batch, t_col)
            allowed = np.zeros(len(t), dtype=bool)
            for values, s, e in _runs(batch, group):
                if values != current:
                    current, free_at = values, np.iinfo(np.int64).min
                    sends.clear()
                if limit < 0:
                    continue
                times = t[s:e]
                i = int(np.searchsorted(times, free_at, "left"))
                while i < len(times):
                    allowed[s + i] = True
                    sends.append(int(times[i]))
                    free_at = sends[-1] + gap_us
                    if len(sends) > limit:
                        free_at = max(free_at, sends[0] + window_us)
                    # a send at the same instant is never free of its own row
                    i = max(i + 1, int(np.searchsorted(times, free_at, "left")))
            yield batch.select(out_schema.names[:-1]).append_column("allowed", pa.array(allowed))

    return (stretched.repartition(*group).sortWithinPartitions(*group, t_col, tie_col)
            .mapInArrow(fold, schema=out_schema))


class SendRules:
    """The two rules over one user's attempts in order, with what they need of
    the past: when the governed limit and the gap end, and the sends of the window."""

    def __init__(self, limit_us: int, gap_us: int, window_us: int, max_in_window: int):
        self.limit_us, self.gap_us, self.window_us, self.most = limit_us, gap_us, window_us, max_in_window
        self.clear()

    def clear(self) -> None:
        self.governed_until = self.gap_until = np.iinfo(np.int64).min
        self.sends: deque[int] = deque(maxlen=self.most + 1)

    def restore(self, governed_until: int, gap_until: int, sends: list[int]) -> None:
        self.governed_until, self.gap_until = governed_until, gap_until
        self.sends = deque(sends, maxlen=self.most + 1)

    def judge(self, t: int, logged: bool, governed: bool, can_send: bool) -> str:
        if logged:
            verdict = "sent"
        elif governed and t < self.governed_until:
            verdict = "limit_reached"
        elif not can_send:
            verdict = "held"
        else:
            capped = t < self.gap_until or (len(self.sends) > self.most and self.sends[0] > t - self.window_us)
            verdict = "frequency_cap" if capped else "sent"
        if verdict == "sent":
            self.sends.append(t)
            self.gap_until = t + self.gap_us
            self.governed_until = t + self.limit_us if governed else self.governed_until
        return verdict


def send_rules(items: DataFrame, keys: list[str], t_col: str, tie_col: str, limit_us: int,
               gap_us: int, window_us: int, max_in_window: int) -> DataFrame:
    """Add ``verdict`` to send attempts that two rules govern together, each
    checked against what was really sent before: ``limit_reached`` (a governed
    attempt within ``limit_us`` of the last governed send), ``frequency_cap``
    (a send in (t - gap, t], or more than ``max_in_window`` in (t - window, t]),
    ``sent``, or ``held`` for an attempt that may not send.

    items: ``is_log`` (a send of the log: recorded as it is, before attempts of
    the same time, and left out of the result), ``governed``, ``can_send``. An
    attempt is recorded only when it is sent."""
    ship_package(items.sparkSession)
    out_schema = T.StructType(items.schema.fields + [T.StructField("verdict", T.StringType())])
    group = [*keys, "_stretch"]

    def fold(batches):
        current, rules = None, SendRules(limit_us, gap_us, window_us, max_in_window)
        for batch in batches:
            is_log = _numpy(batch, "is_log")
            flags = list(zip(_numpy(batch, t_col).tolist(), is_log, _numpy(batch, "governed"),
                             _numpy(batch, "can_send")))
            verdict: list[str] = []
            for values, s, e in _runs(batch, group):
                if values != current:
                    current = values
                    rules.clear()
                verdict += [rules.judge(*f) for f in flags[s:e]]
            out = batch.select(out_schema.names[:-1]).append_column("verdict", pa.array(verdict, pa.string()))
            yield out.filter(pa.array(~is_log.astype(bool)))

    stretched = _stretches(items, keys, t_col, max(limit_us, gap_us, window_us))
    return (stretched.repartition(*group)
            .sortWithinPartitions(*group, t_col, ~F.col("is_log"), tie_col)
            .mapInArrow(fold, schema=out_schema))
