"""Fixture views: put the driver's tables into the reference's data model.

Each view has a DuckDB twin in ``intentlane.plans.oracle_views``; the two
must return the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intentlane.sources.tables import read_table, read_table_stream


def _s(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def v_behavior(spark: SparkSession, sf_dir: str, stream_path: str | None = None,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """Behaviour history: event_id, user_id, action, sku_id, price, event_time.
    With ``stream_path`` the same projection runs over a file stream."""
    cols = ("event_id", "user_id", "event_type", "props", "value", "ts")
    if stream_path is not None:
        ev = read_table_stream(spark, stream_path, *cols,
                               max_files_per_trigger=max_files_per_trigger)
    else:
        ev = read_table(spark, sf_dir, "events", *cols)
    action = (F.when(F.col("event_type") == "click", "view_item")
              .when(F.col("event_type") == "view", "search")
              .when(F.col("event_type") == "signup", "add_to_cart")
              .when(F.col("event_type") == "purchase", "purchase"))
    return ev.select(
        "event_id",
        _s("user_id").alias("user_id"),
        action.alias("action"),
        F.concat(F.lit("sku_"), F.regexp_extract("props", r"([0-9]+)", 1)).alias("sku_id"),
        F.col("value").alias("price"),
        F.col("ts").alias("event_time"),
    )


def v_behavior_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw wire messages in five shapes (two of them rejects)."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id")
    uid = _s("user_id")
    sec = _s(F.lit(1704067200) + F.col("event_id"))
    msec = _s((F.lit(1704067200) + F.col("event_id")) * 1000)
    k = F.col("event_id") % 5
    value = (
        F.when(k == 0, F.concat(F.lit('{"user_id":"'), uid,
                                F.lit('","action":"view_item","sku_id":"s1","timestamp":'), sec,
                                F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"userId":"'), uid,
                               F.lit('","action":"purchase","skuId":"s2","timestamp":'), msec,
                               F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"userId":"'), uid,
                               F.lit('","eventType":"CLICK","skuId":"s3","timestamp":'), sec,
                               F.lit(".5}")))
        .when(k == 3, F.lit('{"action":"search","timestamp":1704067200}'))
        .otherwise(F.lit("not valid json"))
    )
    return ev.select("event_id", value.alias("value"))


def v_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users: id, name, spending_tier, identity_tags (JSON text, some malformed)."""
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    key = F.col("c_custkey")
    tier = (F.when(F.col("c_acctbal") >= 6600, "HIGH")
            .when(F.col("c_acctbal") >= 3300, "MEDIUM").otherwise("LOW"))
    tags = (
        F.when(key % 11 == 0, F.lit("oops"))
        .when(key % 11 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(
            F.lit('["'), F.lower("c_mktsegment"), F.lit('"'),
            F.when(key % 3 == 0, F.lit(',"price_sensitive"')).otherwise(F.lit("")),
            F.when(key % 5 == 0, F.lit(',"vip"')).otherwise(F.lit("")),
            F.when(key % 7 == 0, F.lit(',"new_user"')).otherwise(F.lit("")),
            F.lit("]")))
    )
    return c.select(key.alias("id"), F.col("c_name").alias("name"), tier.alias("spending_tier"),
                    tags.alias("identity_tags"))


def v_users_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with registration and update time (hours after 2020, by id)."""
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    hours = lambda h: F.make_dt_interval(hours=h.cast("int"))
    users = v_users(spark, sf_dir)
    return users.withColumns({"created_at": start + hours(F.col("id")), "updated_at": start + hours(F.col("id") * 2)})


def v_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products: prices 0..590 in steps of 10 hit every tier edge."""
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size")
    key = F.col("p_partkey")
    points = (F.when(key % 4 == 0, F.lit("light; strong;;"))
              .when(key % 4 == 1, F.lit("light；strong, cheap"))
              .when(key % 4 == 2, F.lit(" ")))
    desc = (F.when(key % 6 == 0, F.lit("New arrival"))
            .when(key % 6 == 1, F.lit("LIMITED run"))
            .when(key % 6 == 2, F.lit("On Sale"))
            .when(key % 6 == 3, F.lit("Discount week"))
            .when(key % 6 == 4, F.lit("half off 新品")))
    return p.select(
        F.concat(F.lit("sku_"), _s(key)).alias("sku_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        ((key % 60).cast("double") * 10).alias("price"),
        (F.col("p_size") % 3).cast("int").alias("stock"),
        points.alias("selling_points"),
        desc.alias("description"),
    )


def v_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marketing scripts: blank content and null scenario included."""
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    key = F.col("item_id")
    scenario = (F.when(key % 5 == 0, "cart_abandon").when(key % 5 == 1, "price_drop")
                .when(key % 5 == 2, "new_user").when(key % 5 == 3, "general_promotion"))
    content = F.when(key % 9 == 0, F.lit("  ")).otherwise(F.col("text"))
    tags = F.when(key % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit("tag_a, tag_b"))
    return b.select(key.alias("id"), scenario.alias("scenario"), content.alias("content"),
                    tags.alias("tags"))


def v_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector index: id, scenario, embedding (unit-norm float arrays)."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    return e.select(F.col("vec_id").alias("id"),
                    F.concat(F.lit("s"), _s("label")).alias("scenario"), "embedding")


def v_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors: every vector of the table searches the whole index."""
    return v_index(spark, sf_dir)


def v_sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Send log: purchase events."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    return ev.filter(F.col("event_type") == "purchase").select(
        "event_id", _s("user_id").alias("user_id"), "ts")


def v_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Send attempts: click events."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    return ev.filter(F.col("event_type") == "click").select(
        "event_id", _s("user_id").alias("user_id"), "ts")


def v_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing results; attempt 0 = main topic."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    return ev.select(
        "event_id", _s("user_id").alias("user_id"),
        (F.col("event_id") % 5).cast("int").alias("attempt"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.lit("boom")).alias("error"),
        "ts",
    )


def v_profile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile requests in several id spellings (plain, ``user-<n>``,
    ``u-<n>-x``, leading blank), one per event, de-duplicated."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id")
    uid = _s("user_id")
    k = F.col("event_id") % 4
    rid = (F.when(k == 0, uid).when(k == 1, F.concat(F.lit("user-"), uid))
           .when(k == 2, F.concat(F.lit("u-"), uid, F.lit("-x")))
           .otherwise(F.concat(F.lit(" "), uid)))
    return ev.select(rid.alias("request_id")).distinct()
