"""AUD-1 and the document-only operators DOC-2..5."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.functions.text import parse_tags, parse_user_id
from intentlane.functions.time import raw_time_range
from intentlane.operators.asof import next_within


def promotion_audit(users: DataFrame, intents: DataFrame, behavior_t: DataFrame, window_us: int = P.WINDOW_US) -> DataFrame:
    """AUD-1: per user, was a promotion emitted, how many, the first one's type
    and time, and its latency: the time from the first event that qualified for
    it, the earliest one in its window (t - W, t]."""
    uid = parse_user_id(F.col("user_id").cast("string")).alias("user_id")
    per = intents.groupBy(uid).agg(
        F.count(F.lit(1)).alias("n_intents"), F.min("event_time_us").alias("first_intent_us"),
        F.min_by("event_type", F.struct("event_time_us", "event_id")).alias("event_type"))
    # joined to one row per user, so a user's events are looked at once
    first = (behavior_t.select(uid, "t_us").join(per.select("user_id", "first_intent_us"), "user_id")
             .where((F.col("t_us") <= F.col("first_intent_us")) & (F.col("t_us") > F.col("first_intent_us") - F.lit(window_us)))
             .groupBy("user_id").agg(F.min("t_us").alias("_from")))
    return _audit_rows(users, per.join(first, "user_id", "left"))


def _audit_rows(users: DataFrame, per: DataFrame) -> DataFrame:
    return (users.select(F.col("id").alias("user_id")).join(per, "user_id", "left")
            .select("user_id", F.col("n_intents").isNotNull().alias("emitted"),
                    F.coalesce("n_intents", F.lit(0)).alias("n_intents"), "event_type", "first_intent_us",
                    (F.col("first_intent_us") - F.col("_from")).alias("latency_us")))


def qualified_stream(behavior: DataFrame, intents: DataFrame, window_us: int = P.WINDOW_US, watermark: str = "1 hour") -> DataFrame:
    """AUD-1 on streams: every behaviour event (user_id, event_id, t_us) with
    the promotions whose window (t - W, t] it stands in, a left outer interval
    join. An event that qualified for none leaves with nulls once the watermark
    has passed the last promotion it could have been part of, so state holds
    one window (and the delay) of events and promotions."""
    b = (behavior.select(F.col("user_id").alias("user_id"), F.col("event_id").alias("event_id"), "t_us")
         .withColumn("b_ts", F.timestamp_micros("t_us")).withWatermark("b_ts", watermark))
    i = (intents.select(F.col("user_id").alias("i_user"), F.col("event_id").alias("intent_id"), "event_type",
                        F.col("event_time_us").alias("intent_us"))
         .withColumn("i_ts", F.timestamp_micros("intent_us")).withWatermark("i_ts", watermark))
    within = F.expr(f"user_id = i_user AND i_ts >= b_ts AND i_ts < b_ts + INTERVAL {window_us} MICROSECOND")
    return b.join(i, within, "left_outer").select("user_id", "event_id", "t_us", "intent_id", "event_type", "intent_us")


def audit_of_qualified(users: DataFrame, qualified: DataFrame) -> DataFrame:
    """``promotion_audit`` from what ``qualified_stream`` has written so far."""
    uid = parse_user_id(F.col("user_id").cast("string")).alias("user_id")
    each = (qualified.where(F.col("intent_id").isNotNull())
            .groupBy(uid, "intent_id", "intent_us", "event_type").agg(F.min("t_us").alias("_from")))
    first = F.struct("intent_us", "intent_id")
    per = each.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_intents"), F.min("intent_us").alias("first_intent_us"),
                                      F.min_by("event_type", first).alias("event_type"), F.min_by("_from", first).alias("_from"))
    return _audit_rows(users, per)


def cart_abandon(behavior_t: DataFrame, timeout_us: int, as_of_us: int,
                 cart_action: str = "add_to_cart", buy_action: str = "purchase") -> DataFrame:
    """DOC-2: add-to-cart rows with no purchase of the same user in
    (t, t + timeout], reported once the timeout has passed by ``as_of``."""
    due = F.col("t_us") + F.lit(timeout_us) <= F.lit(as_of_us)
    if "event_time" in behavior_t.columns:     # same bound on the raw column: pushed to the scan
        due = due & raw_time_range(behavior_t, "event_time", hi_us=as_of_us - timeout_us,
                                   hi_inclusive=True)
    carts = behavior_t.filter((F.col("action") == cart_action) & due)
    buys = behavior_t.filter(F.col("action") == buy_action).select("user_id", "t_us")
    checked = next_within(carts, buys, ["user_id"], "t_us", timeout_us, out_col="_next_buy")
    return (checked.filter(F.col("_next_buy").isNull())
            .select("event_id", "user_id", "t_us",
                    (F.col("t_us") + F.lit(timeout_us)).alias("deadline_us")))


def realtime_profile(behavior_t: DataFrame, as_of_us: int, horizon_us: int,
                     cheap_price: float = 20.0) -> DataFrame:
    """DOC-3: users active in [as_of - horizon, as_of): last activity,
    realtime_interest = most frequent SKU (ties: smallest), event count, and
    price_sensitive = mean price below ``cheap_price``. Pre-aggregated per
    (user, sku) before the per-user step."""
    in_range = (F.col("t_us") >= F.lit(as_of_us - horizon_us)) & (F.col("t_us") < F.lit(as_of_us))
    if "event_time" in behavior_t.columns:     # same bounds on the raw column: pushed to the scan
        in_range = in_range & raw_time_range(behavior_t, "event_time", as_of_us - horizon_us, as_of_us)
    recent = behavior_t.filter(in_range)
    per_sku = recent.groupBy("user_id", "sku_id").agg(F.count(F.lit(1)).alias("c"))
    top = per_sku.groupBy("user_id").agg(
        F.min_by("sku_id", F.struct((-F.col("c")).alias("nc"), F.col("sku_id"))).alias("realtime_interest"))
    stats = recent.groupBy("user_id").agg(
        F.max("t_us").alias("last_active_us"), F.count(F.lit(1)).alias("n_events_window"),
        (F.avg("price") < F.lit(cheap_price)).alias("price_sensitive"))
    return stats.join(top, "user_id")


def in_stock_offers(skus: DataFrame, products: DataFrame) -> DataFrame:
    """DOC-4: candidate SKUs kept only when in stock (semi join)."""
    stocked = products.filter(F.col("stock") > 0).select("sku_id", "name", "price", "stock")
    return stocked.join(skus.select("sku_id").distinct(), "sku_id", "left_semi")


def promotion_rules(spark: SparkSession, rules: list[tuple[int, str, str]]) -> DataFrame:
    """Promotion rows (rule_id, description, condition_json) -> parsed
    ``min_spend``."""
    df = spark.createDataFrame(rules, "rule_id int, description string, condition_json string")
    return df.withColumn("min_spend", F.from_json("condition_json", "min_spend double")["min_spend"])


#: parts that each spend bucket's users are dealt to (the rules are copied to every part)
RULE_PARTS = 32


def promotion_eligibility(users: DataFrame, spend: DataFrame, rules: DataFrame,
                          only_tag: str = "price_sensitive", parts: int = RULE_PARTS) -> DataFrame:
    """DOC-5: for users carrying ``only_tag``, every rule whose min_spend their
    spend reaches. An equi-join on the binary order of magnitude: a rule stands
    in the bucket of its min_spend, a user in all buckets up to that of the
    spend (below 1: the first), and only the last of them needs the
    comparison. A bucket's users are dealt to ``parts``, so none is hot. Rules
    without min_spend and users without spend match nothing."""
    def bucket(amount):
        return F.when(amount >= 1, F.least(F.floor(F.log2(amount)), F.lit(1023))).otherwise(F.lit(0)).cast("int")

    dealt = (rules.filter(F.col("min_spend").isNotNull())
             .select(F.col("rule_id").cast("int").alias("rule_id"), F.col("min_spend").cast("double").alias("min_spend"))
             .withColumn("_bucket", bucket(F.col("min_spend")))
             .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    tagged = users.filter(F.array_contains(parse_tags(F.col("identity_tags")), only_tag)) \
        .select(F.col("id").alias("user_id"))
    reached = (tagged.join(spend, "user_id").filter(F.col("spend").isNotNull())
               .withColumn("_bucket", F.explode(F.sequence(F.lit(0), bucket(F.col("spend")))))
               .withColumn("_part", F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int")))
    return (reached.join(dealt, ["_bucket", "_part"]).filter(F.col("min_spend") <= F.col("spend"))
            .select("user_id", "spend", "rule_id", "min_spend"))


def rules_json(thresholds: list[float]) -> list[tuple[int, str, str]]:
    return [(i + 1, f"spend at least {t:g}", json.dumps({"min_spend": t}))
            for i, t in enumerate(thresholds)]
