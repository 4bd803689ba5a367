"""CTX-1 from daily sketches: events and distinct products per user and day,
kept as a count and an HLL sketch, merged over the horizon.

A month of activity reads one small row per user and active day instead of the
raw events. The count is exact; the distinct count is an estimate (relative
error about 1.04 / sqrt(2 ** LG_K), and exact while a user has few products).
The horizon may start within a day: that one day is read from the raw history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.functions.text import parse_user_id
from intentlane.functions.time import raw_time_range
from intentlane.sources.tables import read_behavior_history, utc_day

LG_K = 12       # 4096 registers: 1.6 % standard error
US_PER_DAY = P.US_PER_DAY


def daily_sketches(history: DataFrame, time_col: str = "event_time", lg_k: int = LG_K) -> DataFrame:
    """(event_date, user_id, clicks, products): one row per user and day, combined per task before the shuffle."""
    dated = history.withColumn("event_date", F.to_date(F.col(time_col)))
    return (dated.where(F.col("event_date").isNotNull()).groupBy("event_date", parse_user_id(F.col("user_id").cast("string")).alias("user_id"))
            .agg(F.count(F.lit(1)).alias("clicks"), F.hll_sketch_agg("sku_id", F.lit(lg_k)).alias("products")))


def write_daily_sketches(history: DataFrame, path: str, time_col: str = "event_time") -> str:
    """The days of ``history`` (whole days) as sketches by date; days that are there are replaced, others stay."""
    (daily_sketches(history, time_col).repartitionByRange("event_date", "user_id").sortWithinPartitions("event_date", "user_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path))
    return path


def sketched_activity(spark: SparkSession, sketches: str, history: str, as_of_us: int, lookback_us: int = P.ACTIVITY_LOOKBACK_US,
                      time_col: str = "event_time") -> DataFrame:
    """CTX-1 per user with rows since ``as_of - lookback`` (inclusive, no upper
    bound): total_clicks_30d and an estimate of unique_products_viewed_30d."""
    since = as_of_us - lookback_us
    first_day = since // US_PER_DAY * US_PER_DAY
    whole = read_behavior_history(spark, sketches, since if since == first_day else first_day + US_PER_DAY)
    days = whole.select("user_id", "clicks", "products")
    if since != first_day:      # the horizon starts within this day
        raw = read_behavior_history(spark, history, since).where(F.col("event_date") < F.lit(utc_day(first_day + US_PER_DAY)))
        edge = daily_sketches(raw.where(raw_time_range(raw, time_col, lo_us=since)), time_col)
        days = days.unionByName(edge.select("user_id", "clicks", "products"))
    return days.groupBy("user_id").agg(
        F.sum("clicks").alias("total_clicks_30d"),
        F.hll_sketch_estimate(F.hll_union_agg("products")).alias("unique_products_viewed_30d"))


def users_sketched_activity(users: DataFrame, activity: DataFrame) -> DataFrame:
    """Every user; users without rows get 0 / 0."""
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total_clicks_30d", "unique_products_viewed_30d")]
    return users.select(F.col("id").alias("user_id")).join(activity, "user_id", "left").select("user_id", *zero)
