"""NRM-1 / NRM-2: bind raw wire messages to declared columns.

Both producers' casings are accepted, timestamps in seconds, fractional
seconds or milliseconds are absorbed, and undecodable rows are kept with a
``status`` instead of being silently lost (the reject side output)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.functions import jsonx
from intentlane.functions.time import epoch_number_to_us


def _first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def normalize_behavior(raw: DataFrame, value_col: str = "value", keep_raw: bool = False) -> DataFrame:
    """NRM-1 -> user_id, action, sku_id, price, event_time_us, status; with
    ``keep_raw`` also ``raw``, the message of a rejected row, so that the reject
    output can be mended and replayed."""
    v = jsonx.parse(F.col(value_col))
    obj = jsonx.is_object(v)
    user = _first_nonempty(jsonx.get(v, "$.user_id"), jsonx.get(v, "$.userId"))
    ts_num = jsonx.get(v, "$.timestamp", "double")
    status = (F.when(~obj, F.lit("invalid_json"))
              .when(user.isNull(), F.lit("missing_user"))
              .when(ts_num.isNull(), F.lit("missing_time"))
              .otherwise(F.lit("ok")))
    others = [c for c in raw.columns if c != value_col]
    return raw.select(
        *others,
        F.when(obj, user).alias("user_id"),
        F.when(obj, F.coalesce(jsonx.get(v, "$.action"), jsonx.get(v, "$.eventType"))).alias("action"),
        F.when(obj, F.coalesce(jsonx.get(v, "$.sku_id"), jsonx.get(v, "$.skuId"))).alias("sku_id"),
        F.when(obj, jsonx.get(v, "$.price", "double")).alias("price"),
        F.when(obj, epoch_number_to_us(ts_num)).alias("event_time_us"),
        status.alias("status"),
        *([F.when(status != "ok", F.col(value_col)).alias("raw")] if keep_raw else []),
    )


def decode_intents(raw: DataFrame, value_col: str = "value", keep_payload: bool = False) -> DataFrame:
    """NRM-2 -> user_id, event_type, timestamp_num, status; with
    ``keep_payload`` also reason, context (JSON text) and ``payload``, the
    message itself, of accepted and rejected rows alike.

    user_id = first truthy of userId, user_id (stringified); event_type =
    eventType if truthy, else event_type, defaulting to HIGH_INTENT only when
    that key is absent; timestamp = timestamp or eventTimestamp."""
    v = jsonx.parse(F.col(value_col))
    obj = jsonx.is_object(v)
    user = F.coalesce(jsonx.truthy_str(v, "$.userId"), jsonx.truthy_str(v, "$.user_id"))
    etype = F.coalesce(
        jsonx.truthy_str(v, "$.eventType"),
        F.when(jsonx.present(v, "$.event_type"), jsonx.get(v, "$.event_type"))
        .otherwise(F.lit(P.DEFAULT_INTENT_TYPE)))
    ts_first = jsonx.get(v, "$.timestamp", "double")
    ts = F.when(F.coalesce(ts_first, F.lit(0.0)) != 0, ts_first).otherwise(
        jsonx.get(v, "$.eventTimestamp", "double"))
    status = (F.when(~obj, F.lit("invalid_json"))
              .when(user.isNull(), F.lit("missing_user")).otherwise(F.lit("ok")))
    others = [c for c in raw.columns if c != value_col]
    return raw.select(
        *others,
        F.when(obj, user).alias("user_id"),
        F.when(obj & user.isNotNull(), etype).alias("event_type"),
        F.when(obj & user.isNotNull(), ts).alias("timestamp_num"),
        status.alias("status"),
        *([F.when(obj, jsonx.get(v, "$.reason")).alias("reason"),
           F.when(obj, F.get_json_object(value_col, "$.context")).alias("context"),
           F.col(value_col).alias("payload")] if keep_payload else []),
    )


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "ok")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") != "ok")
