"""CTX-1..6: recent activity, persistent profile, snapshot, combined context
and its text rendering, as joins over whole tables of requests.

All joins are equi-joins on the user id: the users table and the activity
aggregate are hash-partitioned on it (or broadcast by AQE when small);
the activity aggregate is partial (map-side) so a hot user is pre-aggregated
before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.functions import jsonx
from intentlane.functions.text import parse_tags, parse_user_id
from intentlane.functions.time import time_literal

SNAPSHOT_SCHEMA = "id bigint, name string, spending_tier string, identity_tags array<string>"


def _time_at_least(df: DataFrame, col: str, min_us: int):
    """Filter ``col >= min_us`` written against the raw column so that the
    predicate reaches the parquet scan."""
    return F.col(col) >= time_literal(min_us, df.schema[col].dataType)


def activity(behavior: DataFrame, as_of_us: int, lookback_us: int = P.ACTIVITY_LOOKBACK_US,
             exact_distinct: bool = True) -> DataFrame:
    """CTX-1 per user with rows since ``as_of - lookback`` (inclusive, no
    upper bound): total_clicks_30d, unique_products_viewed_30d. Every action
    counts; NULL skus are not distinct products."""
    recent = behavior.filter(_time_at_least(behavior, "event_time", as_of_us - lookback_us))
    distinct = (F.count_distinct("sku_id") if exact_distinct
                else F.approx_count_distinct("sku_id"))
    return (recent.groupBy(parse_user_id(F.col("user_id").cast("string")).alias("user_id"))
            .agg(F.count(F.lit(1)).alias("total_clicks_30d"),
                 distinct.alias("unique_products_viewed_30d")))


def users_activity(users: DataFrame, behavior: DataFrame, as_of_us: int,
                   lookback_us: int = P.ACTIVITY_LOOKBACK_US) -> DataFrame:
    """CTX-1 for every user; users without rows get 0 / 0."""
    act = activity(behavior, as_of_us, lookback_us)
    return (users.select(F.col("id").alias("user_id"))
            .join(act, "user_id", "left")
            .select("user_id",
                    F.coalesce("total_clicks_30d", F.lit(0)).cast("long").alias("total_clicks_30d"),
                    F.coalesce("unique_products_viewed_30d", F.lit(0)).cast("long")
                    .alias("unique_products_viewed_30d")))


def persistent_profiles(requests: DataFrame, users: DataFrame, behavior: DataFrame,
                        as_of_us: int, lookback_us: int = P.ACTIVITY_LOOKBACK_US,
                        request_col: str = "request_id") -> DataFrame:
    """CTX-2: one row per request; profile columns NULL when the id does not
    resolve or no user has it."""
    req = requests.withColumn("_uid", parse_user_id(F.col(request_col)))
    prof = users.select(
        F.col("id").alias("_uid"), "name", "spending_tier",
        parse_tags(F.col("identity_tags")).alias("identity_tags"), F.lit(True).alias("_found"))
    act = activity(behavior, as_of_us, lookback_us).withColumnRenamed("user_id", "_uid")
    joined = req.join(prof, "_uid", "left").join(act, "_uid", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    return joined.select(
        *requests.columns,
        F.when(found, F.col("_uid")).alias("id"),
        "name", "spending_tier", "identity_tags",
        F.when(found, F.coalesce("total_clicks_30d", F.lit(0))).cast("long").alias("total_clicks_30d"),
        F.when(found, F.coalesce("unique_products_viewed_30d", F.lit(0))).cast("long")
        .alias("unique_products_viewed_30d"),
        found.alias("has_profile"),
    )


def user_details(users: DataFrame) -> Column:
    """CTX-2 ``detailed_info``: what the users table says of a user, with its
    dates if the table has them (as ISO text)."""
    # by text, as formatting would pass a timestamp_ntz through the session's time zone
    dates = [(F.translate(F.col(c).cast("string"), " ", "T") if c in users.columns else F.lit(None).cast("string")).alias(c)
             for c in ("created_at", "updated_at")]
    return F.struct(F.col("id").cast("bigint").alias("id"), "name", "spending_tier",
                    parse_tags(F.col("identity_tags")).alias("identity_tags"), *dates)


def profile_documents(requests: DataFrame, users: DataFrame, behavior: DataFrame, as_of_us: int,
                      lookback_us: int = P.ACTIVITY_LOOKBACK_US, request_col: str = "request_id") -> DataFrame:
    """CTX-2 whole: one row per request with ``profile``, null if there is no
    such user: id, name, spending_tier, identity_tags, detailed_info,
    recent_activity(total_clicks_30d, unique_products_viewed_30d)."""
    req = requests.withColumn("_uid", parse_user_id(F.col(request_col)))
    info = users.select(F.col("id").alias("_uid"), user_details(users).alias("_info"))
    act = activity(behavior, as_of_us, lookback_us).withColumnRenamed("user_id", "_uid")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total_clicks_30d", "unique_products_viewed_30d")]
    profile = F.struct(*[F.col(f"_info.{c}").alias(c) for c in ("id", "name", "spending_tier", "identity_tags")],
                       F.col("_info").alias("detailed_info"), F.struct(*zero).alias("recent_activity"))
    return (req.join(info, "_uid", "left").join(act, "_uid", "left")
            .select(*requests.columns, F.when(F.col("_info").isNotNull(), profile).alias("profile")))


def dated_snapshot(users: DataFrame) -> DataFrame:
    """CTX-3 with the dates: (key, doc), the document of ``user_details``."""
    return users.select(F.col("id").cast("string").alias("key"), F.to_json(user_details(users), {"ignoreNullFields": "false"}).alias("doc"))


def profile_snapshot(users: DataFrame) -> DataFrame:
    """CTX-3: one JSON document per user (snake_case keys), keyed by the id
    as text: (key, doc)."""
    return users.select(
        F.col("id").cast("string").alias("key"),
        F.to_json(F.struct(
            F.col("id").cast("bigint").alias("id"), "name", "spending_tier",
            parse_tags(F.col("identity_tags")).alias("identity_tags"))).alias("doc"))


def snapshot_lookup(requests: DataFrame, snapshot: DataFrame,
                    request_col: str = "request_id") -> DataFrame:
    """CTX-4: exact key match on the raw request text; missing, blank or
    malformed documents -> NULL ``cached``."""
    snap = snapshot.select(F.col("key").alias(request_col), "doc")
    # from_json turns malformed text into an all-NULL struct, not NULL:
    # require a JSON object first (a variant parse returns NULL on bad text)
    is_obj = jsonx.is_object(jsonx.parse(F.col("doc")))
    parsed = F.when(is_obj, F.from_json("doc", SNAPSHOT_SCHEMA))
    return (requests.join(snap, request_col, "left")
            .withColumn("cached", parsed))


def user_context(requests: DataFrame, users: DataFrame, snapshot: DataFrame,
                 behavior: DataFrame, as_of_us: int,
                 lookback_us: int = P.ACTIVITY_LOOKBACK_US,
                 request_col: str = "request_id") -> DataFrame:
    """CTX-5: both profiles side by side; ``combined`` only when both exist."""
    pers = persistent_profiles(requests, users, behavior, as_of_us, lookback_us, request_col)
    ctx = snapshot_lookup(pers, snapshot, request_col)
    both = F.col("has_profile") & F.col("cached").isNotNull()
    return ctx.select(
        *requests.columns,
        F.col("cached").isNotNull().alias("has_cached"),
        F.col("has_profile").alias("has_persistent"),
        "id", "name", "spending_tier", "identity_tags", "total_clicks_30d",
        "unique_products_viewed_30d", "doc",
        F.when(both, F.coalesce(F.col("cached.identity_tags"), F.array().cast("array<string>")))
        .alias("cached_tags"),
        F.when(both, F.col("cached.spending_tier")).alias("cached_spending_tier"),
        both.alias("has_combined"),
    )


def context_text(ctx: DataFrame, request_col: str = "request_id") -> DataFrame:
    """CTX-6: the text block handed to the decision step."""
    lab = P.CONTEXT_TEXT_LABELS
    nl = F.lit("\n")
    none = F.lit("None")
    body = F.concat(
        nl, F.lit(lab[0]), F.coalesce(F.col("id").cast("string"), none),
        nl, F.lit(lab[1]), F.coalesce(F.col("name"), none),
        nl, F.lit(lab[2]), F.coalesce(F.col("spending_tier"), none),
        nl, F.lit(lab[3]), F.array_join(F.coalesce("identity_tags", F.array().cast("array<string>")), ", "),
        nl, F.lit(lab[4]), F.coalesce(F.col("doc"), none), nl)
    missing = F.format_string(P.CONTEXT_TEXT_MISSING, F.col(request_col))
    return ctx.select(request_col,
                      F.when(F.col("has_persistent"), body).otherwise(missing).alias("text"))
