"""A key holding a third of all rows: the driver's events at sf0.01 with every
third event re-assigned to one user. The chunked cooldown and the skew-split
sliding count must still give the oracle's answer."""

import duckdb
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.operators.folds import compound_cap
from intentlane.operators.intent import detect_high_intent, sliding_click_count
from intentlane.plans.oracle import high_intent_ctes
from intentlane.plans.oracle_views import VIEWS
from intentlane.sources import views as V
from tests.simulate import compound_cap_sim

SF = "/root/testdata/sf0.01"


def _skewed(spark):
    b = V.v_behavior(spark, SF)
    return b.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit("0"))
                        .otherwise(F.col("user_id")))


def _oracle_fires():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END "
                f"AS user_id) FROM read_parquet('{SF}/events.parquet')")
    ctes = ",\n".join([f"v_behavior AS ({VIEWS['v_behavior']})"] +
                      [f"{n} AS ({sql})" for n, sql in high_intent_ctes()])
    return {r[0] for r in con.execute(f"WITH RECURSIVE {ctes} SELECT event_id FROM hi").fetchall()}


def test_hot_user_third_of_rows(spark):
    b = _skewed(spark)
    assert b.filter(F.col("user_id") == "0").count() * 3 >= b.count() - 3
    want = _oracle_fires()
    for width in (1, 16):
        got = {r.event_id for r in detect_high_intent(b, P.TEST_INTENT, chunk_cooldowns=width).collect()}
        assert got == want, width


def test_hot_user_spreads_over_buckets(spark):
    # the hot user's rows land in many (user, bucket) groups, not one
    b = _skewed(spark)
    counted = sliding_click_count(b, P.TEST_INTENT.window_us)
    groups = (counted.filter(F.col("user_id") == "0")
              .select(F.floor(F.col("t_us") / F.lit(8 * P.TEST_INTENT.window_us)).alias("bk"))
              .distinct().count())
    assert groups >= 3


def test_hot_user_folds_in_several_groups(spark):
    # two thirds of the rows in one user, whose requests pause now and then
    rows = [("hot", day * 86_400_000_000 * 3 + i * 60_000_000, day * 1000 + i)
            for day in range(12) for i in range(200)]
    rows += [(f"u{i}", i * 60_000_000, 10**6 + i) for i in range(1200)]
    df = spark.createDataFrame(rows, "user_id string, t_us long, event_id long")
    capped = compound_cap(df, ["user_id"], "t_us", "event_id", P.COMPOUND_GAP_US, P.COMPOUND_WINDOW_US, 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # small parts are merged otherwise
    try:
        parts = capped.filter("user_id = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1
    assert ({r.event_id for r in capped.filter("allowed").collect()}
            == compound_cap_sim(rows, P.COMPOUND_GAP_US, P.COMPOUND_WINDOW_US, 3))
