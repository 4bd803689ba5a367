"""Inputs the driver's tables lack: prefixed ids, unreadable prices, Java white space, empty errors."""

from pyspark.sql import functions as F

from intentlane.functions import text as X
from intentlane.operators import catalog, context, decision, retry


def _one(spark, df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_ids_blanks_and_trim(spark):
    df = spark.createDataFrame([("12\n",), ("user-123",), ("+5",), ("user-7\n",)], "v string")
    assert _one(spark, df, X.parse_user_id(F.col("v"))) == [(None,), (123,), (5,), (None,)]
    df = spark.createDataFrame([("\t\n",), ("　",), (" ",), ("",), (None,), (" a",)], "v string")
    assert [r[0] for r in _one(spark, df, X.is_blank(F.col("v")))] == [True, True, False, True, True, False]
    df = spark.createDataFrame([("a;\tb\n; \t ;c",)], "v string")
    assert _one(spark, df, X.split_selling_points(F.col("v"))) == [(["a", "b", "c"],)]


def test_unreadable_prices_and_prefixed_users(spark):
    df = spark.createDataFrame([("s1", "n", "abc", "x"), ("s2", "n", "120.5", "3")], "sku_id string, name string, price string, stock string")
    tiers = {r["sku_id"]: r["price_tier"] for r in catalog.with_price_tier(df).collect()}
    assert tiers["s1"] != tiers["s2"]
    assert catalog.catalog_documents(df).count() == 2
    behavior = spark.createDataFrame([("user-123", "a"), ("123", "b"), ("junk", "c")], "user_id string, sku_id string") \
        .withColumn("event_time", F.lit("2024-01-30").cast("timestamp"))
    got = {r["user_id"]: r["total_clicks_30d"] for r in context.activity(behavior, 1706659200000000).collect()}
    assert got[123] == 2


def test_retry_keeps_the_previous_error_and_retries_the_main_topic_once(spark):
    df = spark.createDataFrame([(1, "u", 1, False, "", "old"), (2, "u", 0, False, "new", "old"), (3, "u", 2, False, None, None)],
                               "event_id int, user_id string, attempt int, success boolean, error string, last_error string")
    got = {r["event_id"]: (r["route"], r["last_error"]) for r in retry.route_results(df, 0, max_retries=0).collect()}
    assert got == {1: ("dead_letter", "old"), 2: ("retry", "new"), 3: ("dead_letter", "unknown")}


def test_unknown_tiers_have_no_offers(spark):
    users = spark.createDataFrame([(1, "HIGH"), (2, "odd"), (3, None)], "id int, spending_tier string")
    products = spark.createDataFrame([("a", 50.0), ("b", 600.0)], "sku_id string, price double")
    assert [tuple(r) for r in decision.eligible_offers(users, products).select("sku_id", "spending_tier").collect()] == [("b", "HIGH")]
