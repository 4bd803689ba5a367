"""DOC-2 as a stream: add-to-cart events not followed by a purchase of the
same user within the timeout, emitted once the watermark has passed the
deadline (so no later purchase can still cancel them).

Rows are taken in event-time order (``streaming.ordered``). State is the
user's open carts; a purchase at p closes carts with t < p <= t + timeout, found
by binary search. The key wakes when the watermark passes the earliest
deadline, with or without new rows. Carts and purchases behind the watermark
leave as late rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentlane.streaming.ordered import ordered_fold

HELD = T.StructType([T.StructField("t_us", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("action", T.StringType())])
STATE = T.StructType([T.StructField("open_t", T.ArrayType(T.LongType())), T.StructField("open_id", T.ArrayType(T.LongType()))])
OUT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.StringType()),
                    T.StructField("t_us", T.LongType()), T.StructField("deadline_us", T.LongType())])


def cart_abandon_stream(events: DataFrame, timeout_us: int, cart_action: str = "add_to_cart",
                        buy_action: str = "purchase", watermark: str = "0 seconds") -> DataFrame:
    """events: (event_id, user_id, t_us, action) -> abandoned carts, late."""

    def fold(key: tuple, pdf: pd.DataFrame, state: tuple | None, wm_us: int):
        before_t, before_id = state if state is not None else ([], [])
        carts, buys = pdf[pdf["action"] == cart_action], pdf[pdf["action"] == buy_action]
        t = np.concatenate([np.asarray(before_t, np.int64), carts["t_us"].to_numpy(dtype=np.int64)])
        ids = np.concatenate([np.asarray(before_id, np.int64), carts["event_id"].to_numpy(dtype=np.int64)])
        bought = buys["t_us"].to_numpy(dtype=np.int64)
        after = np.searchsorted(bought, t, "right")         # the first purchase after each cart
        closed = np.zeros(len(t), bool)
        some = after < len(bought)
        closed[some] = bought[after[some]] <= t[some] + timeout_us
        t, ids = t[~closed], ids[~closed]
        due = t + timeout_us < wm_us
        out = pd.DataFrame({"event_id": ids[due], "user_id": key[0], "t_us": t[due], "deadline_us": t[due] + timeout_us})
        if due.all():
            return out, None, -1
        return out, (t[~due].tolist(), ids[~due].tolist()), int(t[~due].min()) + timeout_us

    # other actions only move the watermark
    watched = events.withColumn("action", F.when(F.col("action").isin(cart_action, buy_action), F.col("action")))
    return ordered_fold(watched, "user_id", HELD, STATE, OUT, fold,
                        lambda key, pdf: pdf.assign(user_id=key[0], deadline_us=pdf["t_us"] + timeout_us), watermark,
                        keep=F.col("action").isNotNull())
