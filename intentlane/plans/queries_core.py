"""Registered jobs (see SURVEY section 2.13 for keys and parameters)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.operators import intent as intent_ops
from intentlane.operators import normalize as nrm
from intentlane.operators import context as ctx_ops
from intentlane.operators import sketches as sk
from intentlane.plans.registry import register
from intentlane.session import scratch_path
from intentlane.sources import sinks
from intentlane.sources import views as V
from intentlane.sources.tables import materialise, read_behavior_history, write_behavior_history, write_bucketed

SNAPSHOT_BUCKETS = 16


@register("sliding_click_count")
def q_sliding_click_count(spark: SparkSession, sf: str) -> DataFrame:
    df = intent_ops.sliding_click_count(V.v_behavior(spark, sf), P.TEST_INTENT.window_us)
    return df.select("event_id", "user_id", "n")


@register("sliding_count_by_action")
def q_sliding_count_by_action(spark: SparkSession, sf: str) -> DataFrame:
    df = intent_ops.sliding_click_count(V.v_behavior(spark, sf), P.TEST_INTENT.window_us,
                                        by_action=True)
    return df.select("event_id", "user_id", "action", "n")


@register("high_intent")
def q_high_intent(spark: SparkSession, sf: str) -> DataFrame:
    return intent_ops.flatten_intents(
        intent_ops.detect_high_intent(V.v_behavior(spark, sf), P.TEST_INTENT))


@register("normalize_behavior")
def q_normalize_behavior(spark: SparkSession, sf: str) -> DataFrame:
    df = nrm.normalize_behavior(V.v_behavior_json(spark, sf))
    # rejects carry NULL times: compare as double so NULL survives every client
    return df.withColumn("event_time_us", df["event_time_us"].cast("double"))


@register("decode_intents")
def q_decode_intents(spark: SparkSession, sf: str) -> DataFrame:
    return nrm.decode_intents(V.v_behavior_json(spark, sf))


def _joined(col: str, sep: str = ",") -> F.Column:
    return F.array_join(F.col(col), sep)


@register("normalize_rejects")
def q_normalize_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """NRM-1's side output: rejected messages as they came, with the reason."""
    df = nrm.normalize_behavior(V.v_behavior_json(spark, sf), keep_raw=True)
    return nrm.rejected(df).select("event_id", "status", "raw")


@register("intent_topic")
def q_intent_topic(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-1, SRC-2, NRM-2: the promotions as the topic's messages, written and
    decoded again with reason, context and payload."""
    intents = intent_ops.detect_high_intent(V.v_behavior(spark, sf), P.TEST_INTENT)
    wire = materialise(sinks.intents_to_wire(intents), "intent-topic")
    back = nrm.decode_intents(wire, keep_payload=True)
    field = lambda name: F.get_json_object("context", f"$.{name}")
    return back.select("key", "user_id", "event_type", "reason", field("last_action").alias("last_action"), field("sku_id").alias("sku_id"),
                       field("price").cast("double").alias("price"), F.col("timestamp_num").cast("bigint").alias("event_time_us"), "status",
                       (F.get_json_object("payload", "$.userId") == F.col("user_id")).alias("payload_kept"))


@register("profile_document")
def q_profile_document(spark: SparkSession, sf: str) -> DataFrame:
    """CTX-2 whole: profile with detailed_info and recent_activity, flattened."""
    docs = ctx_ops.profile_documents(V.v_profile_requests(spark, sf), V.v_users_dated(spark, sf), V.v_behavior(spark, sf),
                                     P.TEST_AS_OF_US, P.TEST_ACTIVITY_LOOKBACK_US)
    p = lambda path: F.col(f"profile.{path}")
    return docs.select("request_id", p("id").cast("double").alias("id"), p("name").alias("name"), p("detailed_info.spending_tier").alias("spending_tier"),
                       F.array_join(p("detailed_info.identity_tags"), ",").alias("identity_tags"),
                       p("detailed_info.created_at").alias("created_at"), p("detailed_info.updated_at").alias("updated_at"),
                       p("recent_activity.total_clicks_30d").cast("double").alias("total_clicks_30d"),
                       p("recent_activity.unique_products_viewed_30d").cast("double").alias("unique_products_viewed_30d"))


@register("snapshot_document")
def q_snapshot_document(spark: SparkSession, sf: str) -> DataFrame:
    """CTX-3 whole: snapshot documents with their dates, read back from the written table."""
    snap = spark.read.parquet(sinks.write_snapshot(ctx_ops.dated_snapshot(V.v_users_dated(spark, sf)), scratch_path(spark, "snapshot")))
    field = lambda name: F.get_json_object("doc", f"$.{name}")
    return snap.select("key", field("id").cast("bigint").alias("id"), field("name").alias("name"), field("created_at").alias("created_at"),
                       field("updated_at").alias("updated_at"))


@register("activity_30d")
def q_activity_30d(spark: SparkSession, sf: str) -> DataFrame:
    return ctx_ops.users_activity(V.v_users(spark, sf), V.v_behavior(spark, sf),
                                  P.TEST_AS_OF_US, P.TEST_ACTIVITY_LOOKBACK_US)


def _history(spark: SparkSession, sf: str) -> str:
    """The behaviour as date-partitioned history, loaded in two parts; the days
    of the second week are loaded twice and count once."""
    path = scratch_path(spark, "history")
    behavior = V.v_behavior(spark, sf)
    day = F.dayofmonth("event_time")
    write_behavior_history(behavior.where((day <= 14) | day.isNull()), path)
    write_behavior_history(behavior.where(day > 7), path)
    return path


@register("activity_30d_history")
def q_activity_30d_history(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-7 with CTX-1: the horizon reads only its own days of the history."""
    since = P.TEST_AS_OF_US - P.TEST_ACTIVITY_LOOKBACK_US
    history = read_behavior_history(spark, _history(spark, sf), since)
    return ctx_ops.users_activity(V.v_users(spark, sf), history, P.TEST_AS_OF_US, P.TEST_ACTIVITY_LOOKBACK_US)


@register("activity_30d_sketch")
def q_activity_30d_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """CTX-1 from daily sketches, with a horizon that starts at noon."""
    history = _history(spark, sf)
    path = sk.write_daily_sketches(read_behavior_history(spark, history), scratch_path(spark, "sketches"))
    act = sk.sketched_activity(spark, path, history, P.TEST_AS_OF_US, P.TEST_ACTIVITY_LOOKBACK_US + P.US_PER_DAY // 2)
    return sk.users_sketched_activity(V.v_users(spark, sf), act)


@register("high_intent_category")
def q_high_intent_category(spark: SparkSession, sf: str) -> DataFrame:
    """DOC-6: the promotions with the category their window was about."""
    behavior = V.v_behavior(spark, sf)
    intents = intent_ops.flatten_intents(intent_ops.detect_high_intent(behavior, P.TEST_INTENT))
    out = intent_ops.target_category(intents, intent_ops.with_time_us(behavior), V.v_products(spark, sf), P.TEST_INTENT.window_us)
    return out.select("user_id", "event_id", "event_time_us", "recent_clicks", "target_category")


@register("snapshot_lookup")
def q_snapshot_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """CTX-3, SNK-3, CTX-4: the snapshot is written by key as a bucketed table;
    requests meet it without a shuffle of its side."""
    name = f"profile_snapshot_{uuid.uuid4().hex}"
    write_bucketed(ctx_ops.profile_snapshot(V.v_users(spark, sf)), name, "key", SNAPSHOT_BUCKETS, scratch_path(spark, "snapshot"))
    found = ctx_ops.snapshot_lookup(V.v_profile_requests(spark, sf), spark.table(name))
    return found.select("request_id", F.col("cached.name").alias("name"), F.col("cached.spending_tier").alias("spending_tier"),
                        F.array_join("cached.identity_tags", ",").alias("identity_tags"), F.col("cached").isNotNull().alias("has_cached"))


@register("user_profile")
def q_user_profile(spark: SparkSession, sf: str) -> DataFrame:
    df = ctx_ops.persistent_profiles(V.v_profile_requests(spark, sf), V.v_users(spark, sf),
                                     V.v_behavior(spark, sf), P.TEST_AS_OF_US,
                                     P.TEST_ACTIVITY_LOOKBACK_US)
    return df.select("request_id", F.col("id").cast("double").alias("id"), "name",
                     "spending_tier", _joined("identity_tags").alias("identity_tags"),
                     F.col("total_clicks_30d").cast("double").alias("total_clicks_30d"),
                     F.col("unique_products_viewed_30d").cast("double")
                     .alias("unique_products_viewed_30d"), "has_profile")


@register("profile_snapshot")
def q_profile_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    snap = ctx_ops.profile_snapshot(V.v_users(spark, sf))
    back = snap.select("key", F.from_json("doc", ctx_ops.SNAPSHOT_SCHEMA).alias("p"))
    return back.select("key", F.col("p.id").alias("id"), F.col("p.name").alias("name"),
                       F.col("p.spending_tier").alias("spending_tier"),
                       F.array_join("p.identity_tags", ",").alias("identity_tags"))


def _user_context(spark: SparkSession, sf: str) -> DataFrame:
    users = V.v_users(spark, sf)
    snapshot = ctx_ops.profile_snapshot(users)
    return ctx_ops.user_context(V.v_profile_requests(spark, sf), users, snapshot,
                                V.v_behavior(spark, sf), P.TEST_AS_OF_US,
                                P.TEST_ACTIVITY_LOOKBACK_US)


@register("user_context")
def q_user_context(spark: SparkSession, sf: str) -> DataFrame:
    c = _user_context(spark, sf)
    both = F.col("has_combined")
    return c.select(
        "request_id", "has_cached", "has_persistent", "has_combined",
        F.when(both, F.col("id")).cast("double").alias("c_id"),
        F.when(both, F.col("name")).alias("c_name"),
        F.when(both, F.col("spending_tier")).alias("c_spending_tier"),
        F.when(both, _joined("identity_tags")).alias("c_tags"),
        F.when(both, F.col("total_clicks_30d")).cast("double").alias("c_total_clicks_30d"),
        F.when(both, F.col("unique_products_viewed_30d")).cast("double")
        .alias("c_unique_products_viewed_30d"),
        _joined("cached_tags").alias("cached_tags"), "cached_spending_tier")


@register("context_text")
def q_context_text(spark: SparkSession, sf: str) -> DataFrame:
    return ctx_ops.context_text(_user_context(spark, sf))


@register("high_intent_stream")
def q_high_intent_stream(spark: SparkSession, sf: str) -> DataFrame:
    """INT-5: the events table replayed as a file stream (available-now) that
    ends with a closing row, folded with per-user state in event-time order,
    written with its side output under the shared folder and read back."""
    from intentlane.session import scratch_path, state_partitions
    from intentlane.sources.streams import with_closing_row
    from intentlane.sources.tables import table_path
    from intentlane.streaming.intent_stream import detect_high_intent_stream
    from intentlane.streaming.ordered import read_side_output, write_with_side_output
    # a glob: the file stream source takes a directory or a pattern, not a file
    glob = table_path(sf, "events").replace("/events.parquet", "/[e]vents.parquet")
    src = intent_ops.with_time_us(V.v_behavior(spark, sf, stream_path=glob))
    src = with_closing_row(src.select("user_id", "event_id", "t_us", "action", "sku_id", "price"))
    out = detect_high_intent_stream(src, P.TEST_INTENT)
    base = scratch_path(spark, "high-intent-stream")
    with state_partitions(spark):
        q = write_with_side_output(out, f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return read_side_output(spark, f"{base}/out", "main", out.schema)
