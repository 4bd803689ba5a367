"""Registered governance, decision, retry, audit and document-only jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.functions.text import parse_user_id
from intentlane.functions.time import epoch_us_of
from intentlane.operators import audit as aud
from intentlane.operators import catalog as cat
from intentlane.operators import decision as dec
from intentlane.operators import governance as gov
from intentlane.operators import intent as intent_ops
from intentlane.operators import retry as rty
from intentlane.plans.registry import register
from intentlane.sources import views as V
from intentlane.sources.tables import materialise, read_table, read_table_stream

PROMOTION_THRESHOLDS = [1000.0, 5000.0, 20000.0, 100000.0, 500000.0]


def _t(df: DataFrame, col: str = "ts") -> DataFrame:
    return df.withColumn("t_us", epoch_us_of(df, col))


def _behavior_t(spark: SparkSession, sf: str) -> DataFrame:
    return intent_ops.with_time_us(V.v_behavior(spark, sf))


@register("message_limit_check")
def q_message_limit_check(spark: SparkSession, sf: str) -> DataFrame:
    req = _t(V.v_requests(spark, sf)).select("event_id", "user_id", "t_us")
    sends = _t(V.v_sends(spark, sf)).select("user_id", "t_us")
    out = gov.message_limit_check(req, sends, P.TEST_MESSAGE_LIMIT_US)
    return out.select("event_id", "user_id", "allowed", "reason",
                      F.col("ttl_seconds").cast("double").alias("ttl_seconds"))


@register("last_message_sent")
def q_last_message_sent(spark: SparkSession, sf: str) -> DataFrame:
    return gov.last_message_sent(_t(V.v_sends(spark, sf)), P.TEST_MESSAGE_LIMIT_US)


@register("send_gate")
def q_send_gate(spark: SparkSession, sf: str) -> DataFrame:
    req = _t(V.v_requests(spark, sf)).select("event_id", "user_id", "t_us")
    return gov.send_gate(req, P.TEST_MESSAGE_LIMIT_US)


@register("compound_cap")
def q_compound_cap(spark: SparkSession, sf: str) -> DataFrame:
    req = _behavior_t(spark, sf).select("event_id", "user_id", "t_us")
    return gov.compound_gate(req, P.TEST_COMPOUND_GAP_US, P.TEST_COMPOUND_WINDOW_US,
                             P.COMPOUND_MAX_IN_WINDOW).select("event_id", "user_id", "allowed")


def action_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Send / skip actions derived from behaviour, with some blank fields."""
    b = _behavior_t(spark, sf).filter(F.col("action").isin("purchase", "add_to_cart", "search"))
    u = V.v_users(spark, sf).select("id", "name")
    j = b.join(u, parse_user_id(b["user_id"].cast("string")) == u["id"], "left")
    return j.select(
        "event_id", "user_id", "t_us",
        F.when(F.col("action") == "search", F.lit("skip")).otherwise(F.lit("sms")).alias("kind"),
        F.when(F.col("id") % 13 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("1"), F.lpad(F.col("id").cast("string"), 10, "0"))).alias("phone"),
        F.when(F.col("event_id") % 17 == 0, F.lit(" "))
        .otherwise(F.concat(F.lit("Offer for "), F.col("name"))).alias("message"),
        F.when(F.col("event_id") % 19 == 0, F.lit("")).otherwise(F.lit("browse_only")).alias("reason"))


@register("action_log")
def q_action_log(spark: SparkSession, sf: str) -> DataFrame:
    return gov.action_log(action_requests(spark, sf))


@register("message_length_check")
def q_message_length_check(spark: SparkSession, sf: str) -> DataFrame:
    return gov.message_length_check(V.v_scripts(spark, sf)).select("id", "n_chars", "ok")


@register("scenario_routing")
def q_scenario_routing(spark: SparkSession, sf: str) -> DataFrame:
    return dec.scenario_routing(V.v_behavior(spark, sf)).select("event_id", "user_id", "action",
                                                                 "scenario")


@register("offer_segments")
def q_offer_segments(spark: SparkSession, sf: str) -> DataFrame:
    o = dec.offer_segments(V.v_users(spark, sf))
    return o.select("id", F.array_join("segments", ",").alias("segments"), "primary_segment")


@register("eligible_offers")
def q_eligible_offers(spark: SparkSession, sf: str) -> DataFrame:
    return dec.eligible_offers(V.v_users(spark, sf), V.v_products(spark, sf)).select(
        "spending_tier", "sku_id", "price", "preferred")


def _intents(spark: SparkSession, sf: str) -> DataFrame:
    return intent_ops.flatten_intents(
        intent_ops.detect_high_intent(V.v_behavior(spark, sf), P.TEST_INTENT))


@register("campaign_decision")
def q_campaign_decision(spark: SparkSession, sf: str) -> DataFrame:
    sends = _t(V.v_sends(spark, sf)).select("user_id", "t_us")
    products = V.v_products(spark, sf)
    index = V.v_index(spark, sf).select("id", "embedding")
    vectors = index.withColumn("sku_id", F.concat(F.lit("sku_"), F.col("id").cast("string")))
    # the decision reads the intents twice: they are a table of their own (a
    # topic, where the detector runs as a stream), computed once
    intents = materialise(_intents(spark, sf), "intents")
    return dec.campaign_decision(
        intents, V.v_users(spark, sf), products, cat.catalog_for_index(products), vectors,
        V.v_scripts(spark, sf), index, sends, P.TEST_MESSAGE_LIMIT_US, P.TEST_COMPOUND_GAP_US,
        P.TEST_COMPOUND_WINDOW_US, P.COMPOUND_MAX_IN_WINDOW, P.TEST_MESSAGE_MAX_CHARS)


@register("campaign_decision_stream")
def q_campaign_decision_stream(spark: SparkSession, sf: str) -> DataFrame:
    """DEC-5 over the intent topic in four micro-batches, out of order, with the
    log of sends as a second stream."""
    from intentlane.session import scratch_path, state_partitions
    from intentlane.sources.streams import with_closing_row
    from intentlane.streaming.decision_stream import PREPARED, decide_stream, start_preparation
    from intentlane.streaming.ordered import read_side_output, write_with_side_output
    base = scratch_path(spark, "decision-stream")
    (_intents(spark, sf).withColumn("part", F.col("event_id") % 4).repartition("part").write.partitionBy("part").parquet(f"{base}/topic"))
    topic = spark.read.parquet(f"{base}/topic").drop("part")
    products = V.v_products(spark, sf)
    index = V.v_index(spark, sf).select("id", "embedding")
    tables = {"users": V.v_users(spark, sf), "products": products, "catalog": cat.catalog_for_index(products),
              "vectors": index.withColumn("sku_id", F.concat(F.lit("sku_"), F.col("id").cast("string"))),
              "scripts": V.v_scripts(spark, sf), "script_vectors": index}
    intents = spark.readStream.schema(topic.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/topic/part=*")
    start_preparation(intents, f"{base}/prepared", f"{base}/checkpoint-1", tables, P.TEST_MESSAGE_MAX_CHARS) \
        .trigger(availableNow=True).start().awaitTermination()
    prepared = with_closing_row(spark.readStream.schema(PREPARED).parquet(f"{base}/prepared/batch=*"))
    sends = _t(read_table_stream(spark, _events_glob(sf), "user_id", "event_type", "ts").where("event_type = 'purchase'")
               .withColumn("user_id", F.col("user_id").cast("string"))).select("user_id", "t_us")
    out = decide_stream(prepared, sends, P.TEST_MESSAGE_LIMIT_US, P.TEST_COMPOUND_GAP_US, P.TEST_COMPOUND_WINDOW_US, P.COMPOUND_MAX_IN_WINDOW)
    with state_partitions(spark):
        q = write_with_side_output(out, f"{base}/out", f"{base}/checkpoint-2").trigger(availableNow=True).start()
    q.awaitTermination()
    return dec.action_rows(read_side_output(spark, f"{base}/out", "main", out.schema))


@register("retry_routing")
def q_retry_routing(spark: SparkSession, sf: str) -> DataFrame:
    r = rty.route_results(V.v_results(spark, sf), P.TEST_NOW_MS)
    return r.select("event_id", "user_id", "route", "attempt",
                    F.col("next_retry_at_ms").cast("double").alias("next_retry_at_ms"),
                    F.col("failed_at_ms").cast("double").alias("failed_at_ms"), "last_error", "source")


@register("retry_backoff")
def q_retry_backoff(spark: SparkSession, sf: str) -> DataFrame:
    r = V.v_results(spark, sf)
    return r.select("event_id", "attempt", rty.backoff_seconds(F.col("attempt")).alias("backoff_seconds"))


@register("retry_due")
def q_retry_due(spark: SparkSession, sf: str) -> DataFrame:
    r = _t(V.v_results(spark, sf))
    pending = r.select("event_id", (F.floor(F.col("t_us") / 1000)
                                    + (rty.backoff_seconds(F.col("attempt")) * 1000).cast("long"))
                       .cast("long").alias("next_retry_at_ms"))
    return rty.due(pending, P.TEST_NOW_MS)


@register("promotion_audit")
def q_promotion_audit(spark: SparkSession, sf: str) -> DataFrame:
    a = aud.promotion_audit(V.v_users(spark, sf), _intents(spark, sf), _behavior_t(spark, sf), P.TEST_INTENT.window_us)
    return _audit_columns(a)


@register("promotion_audit_stream")
def q_promotion_audit_stream(spark: SparkSession, sf: str) -> DataFrame:
    """AUD-1 from two streams, the events and the promotions (as their topic
    would be: a table of their own), joined by interval under watermarks."""
    from intentlane.session import scratch_path, state_partitions
    from intentlane.sources.streams import with_closing_row
    base = scratch_path(spark, "audit-stream")
    _intents(spark, sf).write.parquet(f"{base}/topic")
    topic = spark.read.parquet(f"{base}/topic")
    promoted = with_closing_row(spark.readStream.schema(topic.schema).parquet(f"{base}/topic"), "event_time_us")
    behavior = with_closing_row(intent_ops.with_time_us(V.v_behavior(spark, sf, stream_path=_events_glob(sf)))
                                .select("user_id", "event_id", "t_us"))
    out = aud.qualified_stream(behavior, promoted, P.TEST_INTENT.window_us)
    with state_partitions(spark):
        q = (out.writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    qualified = spark.read.schema(out.schema).parquet(f"{base}/out")
    return _audit_columns(aud.audit_of_qualified(V.v_users(spark, sf), qualified))


def _audit_columns(a: DataFrame) -> DataFrame:
    return a.select("user_id", "emitted", "n_intents", "event_type",
                    F.col("first_intent_us").cast("double").alias("first_intent_us"),
                    F.col("latency_us").cast("double").alias("latency_us"))


@register("cart_abandon")
def q_cart_abandon(spark: SparkSession, sf: str) -> DataFrame:
    return aud.cart_abandon(_behavior_t(spark, sf), P.TEST_CART_TIMEOUT_US, P.TEST_AS_OF_US)


@register("realtime_profile")
def q_realtime_profile(spark: SparkSession, sf: str) -> DataFrame:
    r = aud.realtime_profile(_behavior_t(spark, sf), P.TEST_AS_OF_US, P.TEST_REALTIME_HORIZON_US)
    return r.select("user_id", "last_active_us", "n_events_window", "price_sensitive",
                    "realtime_interest")


@register("realtime_profile_stream")
def q_realtime_profile_stream(spark: SparkSession, sf: str) -> DataFrame:
    """DOC-3 on the events before ``as_of`` as a stream, which a closing row takes to that watermark."""
    from intentlane.sources.streams import with_closing_row
    from intentlane.streaming.profile_stream import profiles_as_of, realtime_profile_stream
    src = intent_ops.with_time_us(V.v_behavior(spark, sf, stream_path=_events_glob(sf))).where(F.col("t_us") < P.TEST_AS_OF_US)
    src = src.select("user_id", "event_id", "t_us", "sku_id", F.col("price").cast("double").alias("price"))
    src = with_closing_row(src, at_us=P.TEST_AS_OF_US + P.US_PER_HOUR)
    rows = _run_fold(spark, realtime_profile_stream(src, P.TEST_REALTIME_HORIZON_US), "realtime-profile")
    return profiles_as_of(rows, P.TEST_AS_OF_US).select("user_id", "last_active_us", "n_events_window", "price_sensitive", "realtime_interest")


@register("in_stock_offers")
def q_in_stock_offers(spark: SparkSession, sf: str) -> DataFrame:
    skus = V.v_behavior(spark, sf).select("sku_id")
    return aud.in_stock_offers(skus, V.v_products(spark, sf))


@register("promotion_eligibility")
def q_promotion_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders", "o_custkey", "o_totalprice")
    spend = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.sum("o_totalprice").alias("spend"))
    rules = aud.promotion_rules(spark, aud.rules_json(PROMOTION_THRESHOLDS))
    e = aud.promotion_eligibility(V.v_users(spark, sf), spend, rules)
    return e.select("user_id", F.round("spend", 2).alias("spend"), "rule_id", "min_spend")


def _events_glob(sf: str) -> str:
    from intentlane.sources.tables import table_path
    return table_path(sf, "events").replace("/events.parquet", "/[e]vents.parquet")


@register("send_gate_stream")
def q_send_gate_stream(spark: SparkSession, sf: str) -> DataFrame:
    """GOV-3 on the click events replayed as a file stream (available-now) that ends with a closing row."""
    from intentlane.sources.streams import with_closing_row
    from intentlane.streaming.gate_stream import send_gate_stream
    ev = read_table_stream(spark, _events_glob(sf), "event_id", "user_id", "event_type", "ts")
    req = (ev.filter(F.col("event_type") == "click")
           .select("event_id", F.col("user_id").cast("string").alias("user_id"), "ts"))
    req = with_closing_row(_t(req).select("event_id", "user_id", "t_us"))
    return _run_fold(spark, send_gate_stream(req, P.TEST_MESSAGE_LIMIT_US), "send-gate-stream")


def _run_fold(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    """Run an ordered fold to the end of its input and read what was on time."""
    from intentlane.session import scratch_path, state_partitions
    from intentlane.streaming.ordered import read_side_output, write_with_side_output
    base = scratch_path(spark, name)
    with state_partitions(spark):
        q = write_with_side_output(out, f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return read_side_output(spark, f"{base}/out", "main", out.schema)


@register("retry_routing_stream")
def q_retry_routing_stream(spark: SparkSession, sf: str) -> DataFrame:
    """RTY routing in foreachBatch over the results replayed as a stream;
    the four route outputs are read back together."""
    from intentlane.session import scratch_path
    from intentlane.streaming.retry_stream import start_retry_router
    ev = read_table_stream(spark, _events_glob(sf), "event_id", "user_id", "event_type")
    results = ev.select(
        "event_id", F.col("user_id").cast("string").alias("user_id"),
        (F.col("event_id") % 5).cast("int").alias("attempt"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.lit("boom")).alias("error"))
    base = scratch_path(spark, "retry-router")
    start_retry_router(results, f"{base}/out", f"{base}/checkpoint", P.TEST_NOW_MS).awaitTermination()
    r = spark.read.parquet(f"{base}/out/*/batch=*")
    return r.select("event_id", "user_id", "route", "attempt",
                    F.col("next_retry_at_ms").cast("double").alias("next_retry_at_ms"),
                    F.col("failed_at_ms").cast("double").alias("failed_at_ms"), "last_error", "source")


@register("retry_loop")
def q_retry_loop(spark: SparkSession, sf: str) -> DataFrame:
    """RTY-1..5 closed: the events run as a stream, fail as often as their id
    says, and come back from their own envelopes until they end. One row per
    event with its outcome and what its event object still holds."""
    from intentlane.session import scratch_path
    from intentlane.streaming.retry_loop import RetryLoop, event_json, start_main_topic
    ev = read_table_stream(spark, _events_glob(sf), "event_id", "user_id", "event_type", "value")
    events = ev.select(event_json("event_id", F.col("user_id").cast("string").alias("user_id"), "event_type", "value").alias("event"),
                       F.col("user_id").cast("string").alias("user_id"))

    def process(df: DataFrame) -> DataFrame:
        fails = F.get_json_object("event", "$.event_id").cast("bigint") % 6
        return df.withColumn("success", F.col("attempt") >= fails).withColumn(
            "error", F.when(F.col("attempt") < fails, F.concat(F.lit("boom "), F.col("attempt").cast("string"))))

    base = scratch_path(spark, "retry-loop")
    loop = RetryLoop(spark, f"{base}/store", process)
    start_main_topic(events, loop, f"{base}/checkpoint", P.TEST_NOW_MS).awaitTermination()
    loop.run_until_empty(P.TEST_NOW_MS)
    ended = [loop.outcome(route).withColumn("route", F.lit(route)) for route in ("done", "dead_letter", "invalid")]
    event = lambda name, kind: F.get_json_object("event", f"$.{name}").cast(kind).alias(name)
    return ended[0].unionByName(ended[1]).unionByName(ended[2]).select(
        event("event_id", "bigint"), "user_id", event("event_type", "string"), event("value", "double"), "route", "attempt",
        "last_error", F.col("failed_at_ms").cast("double").alias("failed_at_ms"), "source")


@register("cart_abandon_stream")
def q_cart_abandon_stream(spark: SparkSession, sf: str) -> DataFrame:
    """DOC-2 on the events replayed as a stream: carts are emitted by
    event-time timers once the watermark (zero delay: the latest event time in
    whole milliseconds) passes their deadline."""
    from intentlane.streaming.cart_stream import cart_abandon_stream
    src = intent_ops.with_time_us(V.v_behavior(spark, sf, stream_path=_events_glob(sf)))
    return _run_fold(spark, cart_abandon_stream(src, P.TEST_CART_TIMEOUT_US), "cart-abandon-stream")
