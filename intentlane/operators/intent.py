"""INT-1..4 (+ DOC-1, DOC-6): sliding counts, threshold, greedy cooldown and
the promotion projection, as one batch job over a behaviour table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.functions.time import epoch_us_of
from intentlane.operators.folds import CHUNK_COOLDOWNS, greedy_cooldown
from intentlane.operators.sliding import sliding_count


def with_time_us(behavior: DataFrame, time_col: str = "event_time", out: str = "t_us") -> DataFrame:
    return behavior.withColumn(out, epoch_us_of(behavior, time_col))


def sliding_click_count(behavior: DataFrame, window_us: int = P.WINDOW_US,
                        by_action: bool = False, actions: list[str] | None = None,
                        partition_by: list[str] | None = None) -> DataFrame:
    """INT-1 (every action counted, as the reference does) or DOC-1
    (``by_action``: one window per user and action). ``actions`` optionally
    restricts the counted actions."""
    b = with_time_us(behavior)
    if actions is not None:
        b = b.filter(F.col("action").isin(actions))
    keys = ["user_id", "action"] if by_action else ["user_id"]
    return sliding_count(b, keys, "t_us", "event_id", window_us, out_col="n",
                         partition_by=partition_by)


def detect_high_intent(behavior: DataFrame, p: P.IntentParams = P.IntentParams(),
                       chunk_cooldowns: int = CHUNK_COOLDOWNS,
                       actions: list[str] | None = None) -> DataFrame:
    """Promotions: one row per firing event.

    Columns: user_id, event_id, event_type, reason, event_time_us,
    context (last_action, sku_id, price), recent_clicks. Every action counts
    unless ``actions`` restricts the counted (and promotable) events."""
    if actions is not None:
        behavior = behavior.filter(F.col("action").isin(actions))
    counted = sliding_click_count(behavior, p.window_us)
    qualifying = counted.filter(F.col("n") >= p.threshold)
    fired = greedy_cooldown(qualifying, ["user_id"], "t_us", "event_id", p.cooldown_us,
                            chunk_cooldowns=chunk_cooldowns)
    return promotion_projection(fired, p)


def promotion_projection(fired: DataFrame, p: P.IntentParams = P.IntentParams()) -> DataFrame:
    """INT-4: constant type and reason, context of the triggering event with
    the reference's defaults; DOC-6 adds the window count."""
    return fired.select(
        "user_id", "event_id",
        F.lit(p.event_type).alias("event_type"),
        F.lit(p.reason).alias("reason"),
        F.col("t_us").alias("event_time_us"),
        F.struct(
            F.coalesce(F.col("action"), F.lit(P.CONTEXT_DEFAULT_ACTION)).alias("last_action"),
            F.coalesce(F.col("sku_id"), F.lit(P.CONTEXT_DEFAULT_SKU)).alias("sku_id"),
            F.coalesce(F.col("price").cast("double"), F.lit(P.CONTEXT_DEFAULT_PRICE)).alias("price"),
        ).alias("context"),
        F.col("n").cast("long").alias("recent_clicks"),
    )


def flatten_intents(intents: DataFrame) -> DataFrame:
    return intents.select("user_id", "event_id", "event_type", "reason", "event_time_us",
                          F.col("context.last_action").alias("last_action"),
                          F.col("context.sku_id").alias("sku_id"),
                          F.col("context.price").alias("price"), "recent_clicks")


def target_category(intents: DataFrame, behavior_t: DataFrame, products: DataFrame, window_us: int = P.WINDOW_US) -> DataFrame:
    """DOC-6: the category that the user met most in the window (t - W, t] that
    led to each intent, as ``target_category``; ties go to the category met last,
    then to the smallest name; null if no event of the window has a product with a
    category.

    Events meet intents by user and window-sized time slot (each intent looks
    at the two slots that its window can touch), so a busy user's events are
    compared with the intents near them only, and are counted per intent and
    category before anything is chosen."""
    slot = lambda t: F.floor(t / F.lit(window_us)).cast("bigint")
    wanted = intents.select("user_id", "event_id", F.col("event_time_us").alias("_until"))
    wanted = wanted.withColumn("_slot", F.explode(F.array(slot(F.col("_until")), slot(F.col("_until")) - 1)))
    category = products.select("sku_id", "category").where(F.col("category").isNotNull())
    met = (behavior_t.select("user_id", "sku_id", "t_us", slot(F.col("t_us")).alias("_slot"))
           .join(wanted, ["user_id", "_slot"])
           .where((F.col("t_us") > F.col("_until") - F.lit(window_us)) & (F.col("t_us") <= F.col("_until")))
           .join(category, "sku_id")
           .groupBy("user_id", "event_id", "category").agg(F.count(F.lit(1)).alias("n"), F.max("t_us").alias("last")))
    best = met.groupBy("user_id", "event_id").agg(
        F.min_by("category", F.struct((-F.col("n")).alias("n"), (-F.col("last")).alias("last"), "category")).alias("target_category"))
    return intents.join(best, ["user_id", "event_id"], "left")
