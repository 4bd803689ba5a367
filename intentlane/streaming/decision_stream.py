"""DEC-5 on the intent stream, in two queries.

``start_preparation`` takes micro-batches of intents, joins them with the static
tables (profiles, catalogue, scripts) and writes the prepared actions, a
folder per micro-batch that a repeated batch replaces. ``decide_stream`` reads
them together with the log of sends and folds each user's attempts in
event-time order with keyed state, so the limit and the cap see the sends of
the log and of earlier intents in whatever batches they came. Actions behind
the watermark leave as late rows. The rows equal ``campaign_decision`` over the
same intents, however they are split in batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentlane import params as P
from intentlane.operators.decision import prepare_actions
from intentlane.operators.folds import SendRules
from intentlane.streaming.ordered import ordered_fold

PREPARED = ("event_id bigint, user_id string, t_us bigint, scenario string, segment string, content string, early string, "
            "governed boolean, can_send boolean")
_FIELDS = [("t_us", T.LongType()), ("event_id", T.LongType()), ("scenario", T.StringType()), ("segment", T.StringType()),
           ("content", T.StringType()), ("early", T.StringType()), ("governed", T.BooleanType()), ("can_send", T.BooleanType()),
           ("is_log", T.BooleanType())]
HELD = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
STATE = T.StructType([T.StructField("governed_until", T.LongType()), T.StructField("gap_until", T.LongType()),
                      T.StructField("sends", T.ArrayType(T.LongType()))])
OUT = T.StructType([T.StructField("user_id", T.StringType()), *[T.StructField(n, t) for n, t in _FIELDS if n != "is_log"],
                    T.StructField("verdict", T.StringType())])


def start_preparation(intents: DataFrame, path: str, checkpoint: str, tables: dict[str, DataFrame], max_chars: int = P.MESSAGE_MAX_CHARS):
    """``tables``: users, products, catalog, vectors, scripts, script_vectors, as ``campaign_decision`` takes them."""
    def run(batch: DataFrame, batch_id: int) -> None:
        prepared = prepare_actions(batch, max_chars=max_chars, **tables)
        (prepared.select(*[c.split()[0] for c in PREPARED.split(", ")]).write.mode("overwrite")
         .parquet(f"{path}/batch={batch_id}"))
    return intents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def _fold(limit_us: int, gap_us: int, window_us: int, max_in_window: int):
    def fold(key: tuple, pdf: pd.DataFrame, state: tuple | None, wm_us: int):
        if pdf.empty:       # no send of the past matters any more
            return None, None, -1
        rules = SendRules(limit_us, gap_us, window_us, max_in_window)
        if state is not None:
            rules.restore(*state)
        # sends of the log come before attempts of the same instant
        pdf = pdf.iloc[np.lexsort((pdf["event_id"], ~pdf["is_log"].astype(bool), pdf["t_us"]))]
        verdict = [rules.judge(*f) for f in zip(pdf["t_us"].tolist(), pdf["is_log"], pdf["governed"], pdf["can_send"])]
        out = pdf.assign(user_id=key[0], verdict=verdict)
        horizon = max(rules.governed_until, rules.gap_until, (rules.sends[-1] + window_us) if rules.sends else 0, int(pdf["t_us"].iloc[-1]))
        return out[~out["is_log"].astype(bool)], (int(rules.governed_until), int(rules.gap_until), list(rules.sends)), horizon
    return fold


def decide_stream(prepared: DataFrame, sends: DataFrame, limit_us: int = P.MESSAGE_LIMIT_US, gap_us: int = P.COMPOUND_GAP_US,
                  window_us: int = P.COMPOUND_WINDOW_US, max_in_window: int = P.COMPOUND_MAX_IN_WINDOW, watermark: str = "1 hour") -> DataFrame:
    """Prepared actions with their ``verdict`` and ``late``, from streams of
    prepared actions and of logged sends (user_id, t_us). ``action_rows`` turns
    the rows that are not late into decisions."""
    log = sends.select("user_id", "t_us", F.lit(True).alias("is_log"), F.lit(True).alias("governed"), F.lit(True).alias("can_send"))
    both = prepared.withColumn("is_log", F.lit(False)).unionByName(log, allowMissingColumns=True)

    def late(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(user_id=key[0], verdict=None)
    return ordered_fold(both, "user_id", HELD, STATE, OUT, _fold(limit_us, gap_us, window_us, max_in_window), late, watermark)
