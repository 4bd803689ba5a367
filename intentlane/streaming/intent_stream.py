"""INT-5: streaming intent detection with per-user state.

Source rows (user_id, event_id, t_us, action, sku_id, price) are held per user
until the watermark has passed them (``streaming.ordered``), then folded in
(time, id) order: state keeps the event times of the last window (to count) and
the last fire time (the cooldown). So rows may arrive in any order within
the watermark's delay and the output equals the batch job
(``detect_high_intent``); rows behind the watermark leave by the side output.
A user's state goes once both the window and the lock have passed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentlane import params as P
from intentlane.streaming.ordered import ordered_fold

OUT_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("event_time_us", T.LongType()),
    T.StructField("last_action", T.StringType()),
    T.StructField("sku_id", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("recent_clicks", T.LongType()),
])
STATE_SCHEMA = T.StructType([
    T.StructField("times", T.ArrayType(T.LongType())),
    T.StructField("last_fire", T.LongType()),
])
HELD_SCHEMA = T.StructType([
    T.StructField("t_us", T.LongType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("sku_id", T.StringType()),
    T.StructField("price", T.DoubleType()),
])


def _fold_sorted(times_prev: np.ndarray, t: np.ndarray, last_fire, p: P.IntentParams):
    """Counts and fires for new rows ``t`` (sorted, all >= the retained
    window times ``times_prev``): window counts by binary search over the
    concatenated times, then fire-to-fire jumps over the qualifying rows."""
    all_t = np.concatenate([times_prev, t])
    idx = np.arange(len(times_prev), len(all_t))
    n = idx + 1 - np.searchsorted(all_t, t - p.window_us, side="right")
    q = np.flatnonzero(n >= p.threshold)
    fires = []
    if len(q):
        qt = t[q]
        i = 0 if last_fire is None else int(np.searchsorted(qt, last_fire + p.cooldown_us, "left"))
        while i < len(qt):
            fires.append(int(q[i]))
            last_fire = int(qt[i])
            i = int(np.searchsorted(qt, last_fire + p.cooldown_us, "left"))
    keep_from = int(np.searchsorted(all_t, all_t[-1] - p.window_us, side="right"))
    return n, fires, last_fire, all_t[keep_from:]


def _texts(column: pd.Series, default: str) -> np.ndarray:
    return np.array([v if isinstance(v, str) else default for v in column], dtype=object)


def _promotions(key: tuple, rows: pd.DataFrame, counts, p: P.IntentParams) -> pd.DataFrame:
    price = rows["price"].to_numpy(dtype=np.float64)
    return pd.DataFrame({
        "user_id": np.full(len(rows), key[0], dtype=object),
        "event_id": rows["event_id"].to_numpy(dtype=np.int64),
        "event_type": np.full(len(rows), p.event_type, dtype=object),
        "reason": np.full(len(rows), p.reason, dtype=object),
        "event_time_us": rows["t_us"].to_numpy(dtype=np.int64),
        "last_action": _texts(rows["action"], P.CONTEXT_DEFAULT_ACTION),
        "sku_id": _texts(rows["sku_id"], P.CONTEXT_DEFAULT_SKU),
        "price": np.where(np.isnan(price), P.CONTEXT_DEFAULT_PRICE, price),
        "recent_clicks": counts,
    })


def _fold(p: P.IntentParams):
    def fold(key: tuple, pdf: pd.DataFrame, state: tuple | None, wm_us: int):
        if pdf.empty:       # window and lock have passed
            return None, None, -1
        prev, last_fire = state or ([], None)
        t = pdf["t_us"].to_numpy(dtype=np.int64)
        n, fires, last_fire, kept = _fold_sorted(np.asarray(prev if prev is not None else [], dtype=np.int64), t, last_fire, p)
        horizon = max(int(kept[-1]) + p.window_us, last_fire + p.cooldown_us if last_fire is not None else 0)
        out = _promotions(key, pdf.iloc[fires], n[fires].astype(np.int64), p) if fires else None
        return out, (kept.tolist(), last_fire), horizon
    return fold


def _late(p: P.IntentParams):
    """Late events as rows of the output: what they were, without a count."""
    return lambda key, pdf: _promotions(key, pdf, pd.array([None] * len(pdf), dtype="Int64"), p).assign(event_type=None, reason=None)


def detect_high_intent_stream(events: DataFrame, p: P.IntentParams = P.IntentParams(),
                              watermark: str = "1 hour") -> DataFrame:
    """Streaming promotions from a stream of (user_id, event_id, t_us,
    action, sku_id, price), with ``late`` marking the events that came behind
    the watermark (they have no event_type, reason and count). The watermark
    bounds how late a user's rows may arrive and how long they are held."""
    src = events.withColumn("price", F.col("price").cast("double"))
    return ordered_fold(src, "user_id", HELD_SCHEMA, STATE_SCHEMA, OUT_SCHEMA, _fold(p), _late(p), watermark)
