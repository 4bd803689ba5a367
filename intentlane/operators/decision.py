"""DEC-1..5: the campaign decision as an auditable rule table.

The reference hands these rules to a language model; here they are data:
scenario routing, offer segments, tier eligibility, the per-scenario plan,
and the decision job that composes context, governance and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.functions.text import is_blank, parse_tags, parse_user_id
from intentlane.operators.folds import send_rules
from intentlane.operators.retrieval import product_search, script_search
from intentlane.sources.tables import by_key, materialise

# Our fixed priority of offer segments (the reference states no order).
SEGMENT_RULES = (("premium", "tier", "HIGH"), ("value", "tag", "price_sensitive"),
                 ("welcome", "tag", "new_user"), ("member", "tag", "vip"))
DEFAULT_SEGMENT = "standard"
# DEC-4 plan: scenario -> (retrieval, governed by the message limit)
SCENARIO_PLAN = {"browse": ("product", False), "cart": ("script", True),
                 "purchase": ("product", True)}
HIGH_TIER_MIN_PRICE = 100.0
HIGH_TIER_PREFERRED_PRICE = 500.0


def route(action: Column) -> Column:
    """DEC-1: event type -> scenario ('unrouted' for anything else)."""
    expr = F.lit("unrouted")
    for event, scenario in reversed(list(P.SCENARIO_BY_EVENT.items())):
        expr = F.when(action == event, F.lit(scenario)).otherwise(expr)
    return F.when(action.isNull(), F.lit("unrouted")).otherwise(expr)


def scenario_routing(events: DataFrame, action_col: str = "action") -> DataFrame:
    return events.withColumn("scenario", route(F.col(action_col)))


def segments(tier: Column, tags: Column) -> Column:
    """DEC-2: every matching segment, in priority order."""
    parts = [F.when(tier == v if kind == "tier" else F.array_contains(tags, v), F.lit(name))
             for name, kind, v in SEGMENT_RULES]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def offer_segments(users: DataFrame) -> DataFrame:
    tags = parse_tags(F.col("identity_tags"))
    seg = segments(F.col("spending_tier"), tags)
    return users.select("id", seg.alias("segments"),
                        F.coalesce(F.get(seg, 0), F.lit(DEFAULT_SEGMENT)).alias("primary_segment"))


def eligible_offers(users: DataFrame, products: DataFrame) -> DataFrame:
    """DEC-3: per tier present among the users, the eligible products: HIGH
    excludes prices below 100 and prefers prices above 500. Tiers come from
    a closed set, so products are fanned out over it (no cross join) and
    semi-joined with the tiers that occur."""
    tiers = users.select("spending_tier").filter(F.col("spending_tier").isin("HIGH", "MEDIUM", "LOW")).distinct()
    fan = products.select("sku_id", F.col("price").cast("double").alias("price"),
                          F.explode(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")))
                          .alias("spending_tier"))
    present = fan.join(F.broadcast(tiers), "spending_tier", "left_semi")
    high = F.col("spending_tier") == "HIGH"
    price = F.coalesce(F.col("price"), F.lit(0.0))
    return (present.filter(_eligible(F.col("spending_tier"), price))
            .withColumn("preferred", high & (price > HIGH_TIER_PREFERRED_PRICE)))


def _eligible(tier: Column, price: Column) -> Column:
    return (tier.isNull() | (tier != "HIGH")) | (price >= HIGH_TIER_MIN_PRICE)


def route_intent(event_type: Column, last_action: Column) -> Column:
    """DEC-1 for an intent: its last action refines the event type's scenario."""
    by_action = route(last_action)
    return F.when(by_action != "unrouted", by_action).otherwise(route(event_type))


def trigger_offers(triggers: DataFrame, products: DataFrame, vectors: DataFrame, catalog: DataFrame,
                   k: int = P.SEARCH_K, recall_factor: int = P.RECALL_FACTOR) -> DataFrame:
    """(sku_id, offers): RET-7 around every triggering product, searched once
    per product with its own vector and document. ``offers`` holds at most k
    structs (rank, sku_id, price) that are in stock and another product.

    vectors: id, sku_id, embedding. catalog: CAT-4 documents."""
    docs = catalog.select(F.col("id").alias("sku_id"), F.col("document").alias("query_text"))
    queries = (triggers.select("sku_id").distinct().join(by_key(vectors), "sku_id").join(by_key(docs), "sku_id")
               .select("id", "query_text", "embedding"))
    names = vectors.select(F.col("id").alias("_vid"), "sku_id")
    hits = product_search(queries, vectors.select("id", "embedding"), catalog, k, recall_factor,
                          hit_key=F.concat(F.lit("sku_"), F.col("id").cast("string")))
    stocked = (products.filter(F.col("stock") > 0)
               .select(F.col("sku_id").alias("product_id"),
                       F.coalesce(F.col("price").try_cast("double"), F.lit(0.0)).alias("offer_price")))
    return (hits.select("query_id", "rank", "product_id").join(by_key(stocked), "product_id")
            .join(by_key(names), F.col("query_id") == F.col("_vid"))
            .filter(F.col("product_id") != F.col("sku_id"))
            .groupBy("sku_id")
            .agg(F.sort_array(F.collect_list(F.struct(
                F.col("rank"), F.col("product_id").alias("sku_id"),
                F.col("offer_price").alias("price")))).alias("offers")))


def trigger_scripts(triggers: DataFrame, scripts: DataFrame, script_vectors: DataFrame,
                    vectors: DataFrame, max_chars: int) -> DataFrame:
    """(sku_id, script_id): RET-8 with the triggering product's vector, over
    the cart scenarios in their order; only non-blank texts that keep GOV-7."""
    usable = (scripts.filter(F.col("scenario").isin(*P.CART_SCRIPT_SCENARIOS) & ~is_blank(F.col("content"))
                             & (F.char_length("content") <= max_chars)))
    index = usable.select("id", "scenario").join(by_key(script_vectors), "id")
    n = len(P.CART_SCRIPT_SCENARIOS)
    asked = (triggers.select("sku_id").distinct().join(by_key(vectors), "sku_id")
             .select("id", "sku_id", "embedding",
                     F.posexplode(F.array(*[F.lit(s) for s in P.CART_SCRIPT_SCENARIOS]))
                     .alias("_pos", "scenario"))
             .withColumn("id", F.col("id") * n + F.col("_pos")))
    hits = script_search(asked.select("id", "embedding", "scenario"), index, k=1, all_have_scenario=True)
    return (hits.join(by_key(asked.select(F.col("id").alias("query_id"), "sku_id", "_pos")), "query_id")
            .groupBy("sku_id").agg(F.min_by(hits["id"], F.col("_pos")).alias("script_id")))


def prepare_actions(intents: DataFrame, users: DataFrame, products: DataFrame, catalog: DataFrame,
                    vectors: DataFrame, scripts: DataFrame, script_vectors: DataFrame,
                    max_chars: int = P.MESSAGE_MAX_CHARS) -> DataFrame:
    """Steps 1 and 2 of DEC-5, which look at no other intent: event_id, user_id,
    t_us, scenario, segment, content, early (a reason to skip at once),
    governed, can_send."""
    prof = users.select(F.col("id").alias("_uid"), "spending_tier",
                        parse_tags(F.col("identity_tags")).alias("_tags"), F.lit(True).alias("_found"))
    x = materialise(
        intents.withColumn("scenario", route_intent(F.col("event_type"), F.col("last_action")))
        .withColumn("_uid", parse_user_id(F.col("user_id"))).join(by_key(prof), "_uid", "left")
        .select("event_id", "user_id", "event_time_us", "sku_id", "scenario", "spending_tier", "_found",
                F.coalesce(F.get(segments(F.col("spending_tier"), F.col("_tags")), 0), F.lit(DEFAULT_SEGMENT)).alias("segment")),
        "decision-intents")     # read for offers, for scripts and for the actions
    by_product = [s for s, (r, _) in SCENARIO_PLAN.items() if r == "product"]
    by_script = [s for s, (r, _) in SCENARIO_PLAN.items() if r == "script"]
    offers = trigger_offers(x.filter(F.col("scenario").isin(by_product)), products, vectors, catalog)
    chosen = trigger_scripts(x.filter(F.col("scenario").isin(by_script)), scripts, script_vectors,
                             vectors, max_chars)
    high = F.coalesce(F.col("spending_tier") == "HIGH", F.lit(False))
    ordered = F.transform(
        F.filter("offers", lambda o: _eligible(F.col("spending_tier"), o["price"])),
        lambda o: F.struct((~(high & (o["price"] > HIGH_TIER_PREFERRED_PRICE))).alias("later"),
                           o["rank"].alias("rank"), o["sku_id"].alias("sku_id")))
    x = (x.join(by_key(offers), "sku_id", "left").join(by_key(chosen), "sku_id", "left")
         .withColumn("content", F.when(F.col("scenario").isin(by_product),
                                       F.concat(F.lit("sku:"), F.array_min(ordered)["sku_id"]))
                     .when(F.col("scenario").isin(by_script),
                           F.concat(F.lit("script:"), F.col("script_id").cast("string")))))
    early = (F.when(F.col("_found").isNull(), F.lit("no_profile"))
             .when(F.col("scenario") == "unrouted", F.lit("unrouted_event")))
    governed = F.col("scenario").isin([s for s, (_, g) in SCENARIO_PLAN.items() if g])
    return x.select(
        "event_id", "user_id", F.col("event_time_us").alias("t_us"), "scenario", "segment", "content",
        early.alias("early"), (governed & early.isNull()).alias("governed"),
        (early.isNull() & F.col("content").isNotNull()).alias("can_send"))


def action_rows(judged: DataFrame) -> DataFrame:
    """Step 3's rows: event_id, user_id, scenario, segment, action, reason, content, success."""
    sent = F.col("verdict") == "sent"
    reason = F.coalesce(F.col("early"), F.when(F.col("verdict") == "held", F.lit("no_content"))
                        .when(~sent, F.col("verdict")))
    return judged.select("event_id", "user_id", "scenario", "segment",
                         F.when(sent, F.lit("SEND")).otherwise(F.lit("SKIP")).alias("action"),
                         reason.alias("reason"), F.when(sent, F.col("content")).alias("content"),
                         F.lit(True).alias("success"))


def campaign_decision(intents: DataFrame, users: DataFrame, products: DataFrame, catalog: DataFrame,
                      vectors: DataFrame, scripts: DataFrame, script_vectors: DataFrame,
                      sends: DataFrame, limit_us: int = P.MESSAGE_LIMIT_US,
                      gap_us: int = P.COMPOUND_GAP_US, window_us: int = P.COMPOUND_WINDOW_US,
                      max_in_window: int = P.COMPOUND_MAX_IN_WINDOW,
                      max_chars: int = P.MESSAGE_MAX_CHARS) -> DataFrame:
    """DEC-5: one action row per intent.

    1. scenario from the event type, refined by the last action (DEC-1);
       profile, tier and tags by the user id.
    2. content: for browse and purchase the best offer near the triggering
       product (RET-7) that is in stock, another product and allowed for the
       tier (DEC-3; preferred prices first); for cart the closest usable script
       (RET-8) of cart_abandon, else price_drop. Retrieval runs once per
       triggering product, not per intent.
    3. check-then-record: sends of the log and of this job count for the
       message limit (cart and purchase) and the compound cap (all).

    Reasons in order: no_profile, unrouted_event, limit_reached, no_content,
    frequency_cap."""
    items = prepare_actions(intents, users, products, catalog, vectors, scripts, script_vectors, max_chars)
    # only users with an intent need their part of the log
    log = (sends.join(by_key(intents.select("user_id").distinct()), "user_id", "left_semi")
           .select("user_id", "t_us", F.lit(True).alias("is_log"), F.lit(True).alias("governed"),
                   F.lit(True).alias("can_send")))
    judged = send_rules(items.withColumn("is_log", F.lit(False)).unionByName(log, allowMissingColumns=True), ["user_id"],
                        "t_us", "event_id", limit_us, gap_us, window_us, max_in_window)
    return action_rows(judged)
