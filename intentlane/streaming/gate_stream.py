"""GOV-3 as a stream: check-then-record per user with keyed state.

Attempts are judged in event-time order (``streaming.ordered``): one is allowed
when no send happened in the period before it, and then becomes the new
send. So an attempt that arrives late, but before the watermark, is judged by
the sends before it, never by one after it; an attempt behind the watermark
leaves as a late row without a verdict. State is the last send time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from intentlane import params as P
from intentlane.streaming.ordered import ordered_fold

HELD = T.StructType([T.StructField("t_us", T.LongType()), T.StructField("event_id", T.LongType())])
STATE = T.StructType([T.StructField("last_send", T.LongType())])
OUT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.StringType()),
                    T.StructField("t_us", T.LongType()), T.StructField("allowed", T.BooleanType())])


def send_gate_stream(requests: DataFrame, period_us: int = P.MESSAGE_LIMIT_US,
                     watermark: str = "1 hour") -> DataFrame:
    """requests: (event_id, user_id, t_us) -> same + allowed, late."""

    def gate(key: tuple, pdf: pd.DataFrame, state: tuple | None, wm_us: int):
        if pdf.empty:       # the period after the last send has passed
            return None, None, -1
        last = state[0] if state is not None else None
        t = pdf["t_us"].to_numpy(dtype=np.int64)
        allowed = np.zeros(len(t), dtype=bool)
        # jump from send to send with a binary search (the greedy cooldown)
        i = 0 if last is None else int(np.searchsorted(t, last + period_us, "left"))
        while i < len(t):
            allowed[i] = True
            last = int(t[i])
            i = int(np.searchsorted(t, last + period_us, "left"))
        return pdf.assign(user_id=key[0], allowed=allowed), (last,), last + period_us

    return ordered_fold(requests, "user_id", HELD, STATE, OUT, gate,
                        lambda key, pdf: pdf.assign(user_id=key[0], allowed=None), watermark)
