"""DOC-3 as a stream: the realtime profile of each user, with expiry.

State is the user's events of the last ``horizon`` before the watermark. When
events come due, or the watermark passes the expiry of the oldest one, the
profile is computed anew and emitted with the watermark as its ``as_of_us``; a
user whose last event has expired gets a row with no events, which retracts
the profile. So at any watermark the latest row of a user is the profile that
the batch job (``realtime_profile``) gives as of that time, users without events left out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentlane.streaming.ordered import ordered_fold

HELD = T.StructType([T.StructField("t_us", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("sku_id", T.StringType()),
                     T.StructField("price", T.DoubleType())])
STATE = T.StructType([T.StructField("t", T.ArrayType(T.LongType())), T.StructField("sku", T.ArrayType(T.StringType())),
                      T.StructField("price", T.ArrayType(T.DoubleType()))])
OUT = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("as_of_us", T.LongType()), T.StructField("last_active_us", T.LongType()),
                    T.StructField("n_events_window", T.LongType()), T.StructField("price_sensitive", T.BooleanType()),
                    T.StructField("realtime_interest", T.StringType())])


def _interest(skus: list) -> str | None:
    """The most frequent item, of equally frequent ones a missing item first, then the smallest."""
    counts: dict = {}
    for s in skus:
        counts[s] = counts.get(s, 0) + 1
    return min(counts, key=lambda s: (-counts[s], s is not None, s or ""))


def realtime_profile_stream(events: DataFrame, horizon_us: int, cheap_price: float = 20.0, watermark: str = "1 hour") -> DataFrame:
    """events: (user_id, event_id, t_us, sku_id, price) -> profile rows, late."""

    def fold(key: tuple, pdf: pd.DataFrame, state: tuple | None, wm_us: int):
        t, sku, price = [list(x) for x in state] if state is not None else ([], [], [])
        t, sku = t + pdf["t_us"].tolist(), sku + [v if isinstance(v, str) else None for v in pdf["sku_id"]]
        price = price + [None if v is None or v != v else v for v in pdf["price"]]
        live = [i for i, x in enumerate(t) if x >= wm_us - horizon_us]
        t, sku, price = ([c[i] for i in live] for c in (t, sku, price))
        row = {"user_id": key[0], "as_of_us": wm_us, "last_active_us": None, "n_events_window": len(t), "price_sensitive": None, "realtime_interest": None}
        if not t:
            return pd.DataFrame([row]), None, -1
        known = [p for p in price if p is not None]
        row |= {"last_active_us": max(t), "price_sensitive": bool(np.mean(known) < cheap_price) if known else None, "realtime_interest": _interest(sku)}
        return pd.DataFrame([row]), (t, sku, price), min(t) + horizon_us

    def late(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": key[0], "as_of_us": None, "last_active_us": pdf["t_us"], "n_events_window": None, "price_sensitive": None,
                             "realtime_interest": pdf["sku_id"]})
    src = events.withColumn("price", F.col("price").cast("double"))
    return ordered_fold(src, "user_id", HELD, STATE, OUT, fold, late, watermark)


def profiles_as_of(rows: DataFrame, as_of_us: int) -> DataFrame:
    """The profiles at a watermark, from the rows emitted so far."""
    latest = Window.partitionBy("user_id").orderBy(F.desc("as_of_us"))
    return (rows.where(F.col("as_of_us") <= as_of_us).withColumn("_n", F.row_number().over(latest))
            .where("_n = 1 and n_events_window > 0").drop("_n"))
