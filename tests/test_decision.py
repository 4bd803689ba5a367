"""DEC-1..5 rule table on hand-made inputs."""

from pyspark.sql import functions as F

from intentlane.operators import decision as dec
from intentlane.operators.catalog import catalog_for_index

MIN = 60_000_000
H = 60 * MIN


def _decide(spark, intents, sends=(), sold_out=()):
    intents = spark.createDataFrame(
        [(u, e, t, "high_interest_detected", a, s) for u, e, t, a, s in intents],
        "user_id string, event_id long, event_time_us long, event_type string, last_action string, sku_id string")
    users = spark.createDataFrame([
        (1, "a", "HIGH", '["vip"]'), (2, "b", "LOW", '["price_sensitive"]'), (3, "c", "MEDIUM", None),
        (4, "d", "LOW", "oops")], "id long, name string, spending_tier string, identity_tags string")
    products = spark.createDataFrame([
        (f"sku_{i}", name, price, 0 if i in sold_out else 5) for i, name, price in
        ((1, "one", 50.0), (2, "two", 20.0), (3, "three", 300.0), (4, "four", 900.0))],
        "sku_id string, name string, price double, stock int").selectExpr(
        "*", "'bags' AS category", "'light' AS selling_points", "'plain' AS description")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.5, 0.5]), (4, [0.0, 1.0])],
                                    "id long, embedding array<float>")
    scripts = spark.createDataFrame([(1, "price_drop", "drop"), (2, "cart_abandon", "come back"),
                                     (3, "cart_abandon", "  "), (4, "cart_abandon", "x" * 71)],
                                    "id long, scenario string, content string")
    log = spark.createDataFrame(list(sends), "user_id string, t_us long")
    out = dec.campaign_decision(
        intents, users, products, catalog_for_index(products),
        vectors.withColumn("sku_id", F.concat(F.lit("sku_"), "id")), scripts, vectors, log)
    return {r.event_id: r for r in out.collect()}


def test_campaign_decision_content_and_reasons(spark):
    got = _decide(spark, [
        ("1", 1, 100 * H, "view_item", "sku_1"),       # HIGH: the cheap neighbour is no offer
        ("2", 2, 100 * H, "add_to_cart", "sku_2"),     # a logged send 10 minutes earlier
        ("3", 3, 100 * H, "add_to_cart", "sku_3"),     # cart: the usable cart_abandon script
        ("4", 4, 100 * H, "search", "sku_1"),          # the event type routes to browse
        ("user-99", 5, 100 * H, "purchase", "sku_1"),  # no profile
        ("3", 6, 200 * H, "purchase", "unknown"),      # a product nobody knows is never sent
    ], [("2", 100 * H - 10 * MIN), ("3", 80 * H)])
    assert (got[1].action, got[1].content, got[1].segment) == ("SEND", "sku:sku_3", "premium")
    assert (got[2].action, got[2].reason, got[2].segment) == ("SKIP", "limit_reached", "value")
    assert (got[3].action, got[3].content, got[3].scenario) == ("SEND", "script:2", "cart")
    assert (got[4].action, got[4].content, got[4].scenario) == ("SEND", "sku:sku_2", "browse")
    assert (got[5].reason, got[5].content) == ("no_profile", None)
    assert (got[6].action, got[6].reason, got[6].content) == ("SKIP", "no_content", None)


def test_campaign_decision_skips_sold_out_offers(spark):
    browse = [("4", 1, 100 * H, "view_item", "sku_1")]
    assert _decide(spark, browse, sold_out=(2,))[1].content == "sku:sku_3"
    assert _decide(spark, browse, sold_out=(2, 3))[1].reason == "no_content"


def test_campaign_decision_checks_then_records(spark):
    got = _decide(spark, [
        ("2", 1, 100 * H, "purchase", "sku_1"),                # sent, and recorded
        ("2", 2, 100 * H + 10 * MIN, "purchase", "sku_1"),     # within 30 minutes of it
        ("2", 3, 100 * H + 10 * MIN, "view_item", "sku_1"),    # browse has no message limit, but the hour's cap
        ("2", 4, 100 * H + 30 * MIN, "purchase", "sku_1"),     # the limit has ended, the hour has not
        ("2", 5, 101 * H, "view_item", "sku_1"),
        ("2", 6, 102 * H, "view_item", "sku_1"),
        ("2", 7, 103 * H, "view_item", "sku_1"),               # the fourth: 3 sent before it is not more than 3
        ("2", 8, 104 * H, "view_item", "sku_1"),               # the fifth within 24 hours
        ("2", 9, 124 * H, "view_item", "sku_1"),               # the first has left the window
    ])
    assert {e: got[e].reason for e in sorted(got)} == {
        1: None, 2: "limit_reached", 3: "frequency_cap", 4: "frequency_cap", 5: None, 6: None, 7: None,
        8: "frequency_cap", 9: None}


def test_segments_and_eligibility(spark):
    users = spark.createDataFrame([(1, "HIGH", '["price_sensitive","vip"]'), (2, "LOW", None)],
                                  "id long, spending_tier string, identity_tags string")
    seg = {r.id: (r.segments, r.primary_segment) for r in dec.offer_segments(users).collect()}
    assert seg == {1: (["premium", "value", "member"], "premium"), 2: ([], "standard")}
    prods = spark.createDataFrame([("a", 99.0), ("b", 100.0), ("c", 501.0)], "sku_id string, price double")
    el = {(r.spending_tier, r.sku_id): r.preferred for r in dec.eligible_offers(users, prods).collect()}
    assert el == {("HIGH", "b"): False, ("HIGH", "c"): True, ("LOW", "a"): False, ("LOW", "b"): False,
                  ("LOW", "c"): False}
