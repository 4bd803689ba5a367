"""Boundary fixtures for the scalar rules (FIXTURES section 3)."""

from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.functions.text import (merchandising_flags, parse_tags, parse_user_id, price_tier,
                                       split_selling_points)
from intentlane.operators import catalog as cat
from intentlane.operators import governance as gov
from intentlane.operators import normalize as nrm
from intentlane.operators import retry as rty
from intentlane.operators.context import activity
from tests.simulate import compound_cap_sim


def _one_col(spark, values, typ, expr):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_user_id_rule(spark):
    ids = ["12", "+5", "-5", "user-123", "user-123-4", "user-", "abc", " 5",
           "12345678901234567890", None, "a--5"]
    got = _one_col(spark, ids, "string", parse_user_id)
    assert got == [12, 5, -5, 123, 123, None, None, None, None, None, None]


def test_tags(spark):
    got = _one_col(spark, ['["a","b"]', "oops", None, "  ", "[]"], "string", parse_tags)
    assert got == [["a", "b"], [], [], [], []]


def test_selling_point_split(spark):
    got = _one_col(spark, ["a;b", "a；b", "a, b", "a;;b", " ", None], "string", split_selling_points)
    assert got == [["a", "b"], ["a", "b"], ["a", "b"], ["a", "b"], [], []]


def test_price_tier_edges(spark):
    got = _one_col(spark, [99.99, 100.0, 300.0, 300.01, 500.0, 500.01, None], "double", price_tier)
    assert got == [P.PRICE_TIER_AFFORDABLE, P.PRICE_TIER_STANDARD, P.PRICE_TIER_STANDARD,
                   P.PRICE_TIER_MODERATE, P.PRICE_TIER_MODERATE, P.PRICE_TIER_EXPENSIVE,
                   P.PRICE_TIER_AFFORDABLE]


def test_merchandising_flags(spark):
    vals = ["New", "LIMITED", "Sale", "discount", "Discount", "off", "OFF", "新品", "限量"]
    got = _one_col(spark, vals, "string", merchandising_flags)
    assert got == [P.FLAG_NEW, P.FLAG_LIMITED, P.FLAG_SALE, P.FLAG_SALE, "", P.FLAG_SALE, "",
                   P.FLAG_NEW, P.FLAG_LIMITED]


def test_decode_intents_cases(spark):
    msgs = ['{"userId":"u1","eventType":"PURCHASE_INTENT","timestamp":5}',
            '{"user_id":"u2","event_type":"ADD_TO_CART"}',
            '{"user_id":"u3"}',
            '{"user_id":"u4","event_type":null}',
            '{"user_id":"u5","event_type":""}',
            '{"userId":"","user_id":"u6","eventType":"","event_type":"X"}',
            '{"userId":0,"user_id":7}',
            '{"eventType":"X"}', 'not json', '[1,2]']
    df = spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "i int, value string")
    rows = {r.i: r for r in nrm.decode_intents(df).collect()}
    assert (rows[0].user_id, rows[0].event_type, rows[0].timestamp_num) == ("u1", "PURCHASE_INTENT", 5.0)
    assert rows[1].event_type == "ADD_TO_CART"
    assert rows[2].event_type == "HIGH_INTENT"
    assert rows[3].event_type is None and rows[3].status == "ok"
    assert rows[4].event_type == ""
    assert (rows[5].user_id, rows[5].event_type) == ("u6", "X")
    assert rows[6].user_id == "7"
    assert [rows[i].status for i in (7, 8, 9)] == ["missing_user", "invalid_json", "invalid_json"]


def test_normalize_behavior_units(spark):
    msgs = ['{"userId":"a","action":"view_item","timestamp":1708234000}',
            '{"user_id":"a","action":"view_item","timestamp":1708234000123}',
            '{"user_id":"a","eventType":"CLICK","timestamp":1708234000.25}']
    df = spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "i int, value string")
    got = [r.event_time_us for r in nrm.normalize_behavior(df).orderBy("i").collect()]
    assert got == [1708234000_000000, 1708234000_123000, 1708234000_250000]


def test_activity_window_inclusive(spark):
    as_of = 1_706_659_200_000_000
    lb = 30 * P.US_PER_DAY
    rows = [("1", "s1", as_of - lb), ("1", "s1", as_of - lb - 1), ("1", None, as_of - 5),
            ("1", "s2", as_of + 10)]
    df = spark.createDataFrame(rows, "user_id string, sku_id string, t long") \
        .withColumn("event_time", F.timestamp_micros("t"))
    r = activity(df, as_of, lb).collect()[0]
    assert (r.total_clicks_30d, r.unique_products_viewed_30d) == (3, 2)


def test_message_limit_boundaries(spark):
    p = P.MESSAGE_LIMIT_US
    s = 1_000_000_000_000
    req = spark.createDataFrame([(1, "u", s + p - 1), (2, "u", s + p), (3, " ", s), (4, "v", s),
                                 (5, "u", s)], "event_id long, user_id string, t_us long")
    sends = spark.createDataFrame([("u", s)], "user_id string, t_us long")
    got = {r.event_id: (r.allowed, r.reason, r.ttl_seconds)
           for r in gov.message_limit_check(req, sends, p).collect()}
    assert got[1] == (False, "limit_reached", 0)
    assert got[2] == (True, None, None)
    assert got[3] == (False, "missing_user_id", None)
    assert got[4] == (True, None, None)
    assert got[5] == (False, "limit_reached", 1800)


def test_compound_cap_matches_simulation(spark):
    import random
    rnd = random.Random(3)
    rows, t = [], 0
    for i in range(400):
        t += rnd.randint(1, 90) * 60_000_000
        rows.append(("u" + str(i % 3), t, i))
    df = spark.createDataFrame(rows, "user_id string, t_us long, event_id long")
    out = gov.compound_gate(df, P.COMPOUND_GAP_US, P.COMPOUND_WINDOW_US, P.COMPOUND_MAX_IN_WINDOW)
    got = {r.event_id for r in out.collect() if r.allowed}
    assert got == compound_cap_sim(rows, P.COMPOUND_GAP_US, P.COMPOUND_WINDOW_US,
                                   P.COMPOUND_MAX_IN_WINDOW)


def test_retry_schedule(spark):
    got = _one_col(spark, [0, 1, 2, 3, 7, -1], "int", rty.backoff_seconds)
    assert got == [0.0, 1.0, 2.0, 4.0, 60.0, 0.0]
    res = spark.createDataFrame(
        [(1, "u", 0, False, "boom"), (2, "u", 2, False, None), (3, "u", 3, False, "x"),
         (4, "u", 1, True, None), (5, None, 0, False, None)],
        "event_id long, user_id string, attempt int, success boolean, error string")
    got = {r.event_id: r for r in rty.route_results(res, 1000).collect()}
    assert (got[1].route, got[1].attempt, got[1].source, got[1].next_retry_at_ms) == ("retry", 1, "main", 2000)
    assert (got[2].route, got[2].attempt, got[2].source, got[2].next_retry_at_ms) == ("retry", 3, None, 5000)
    assert (got[3].route, got[3].attempt, got[3].failed_at_ms, got[3].source) == ("dead_letter", 4, 1000, "retry")
    assert got[4].route == "done" and got[5].route == "invalid"


def test_product_upsert_semantics(spark):
    existing = spark.createDataFrame(
        [("a", "old", "p", 1.0, 1, 10, 10), ("b", "keep", "q", 2.0, 2, 10, 10)],
        "sku_id string, name string, selling_points string, price double, stock int, "
        "created_at_us long, updated_at_us long")
    batch = spark.createDataFrame(
        [(None, "a", "new1", ["x", "y"], None, None, 1), (None, "a", "new2", ["z"], 5.0, 3, 2),
         ("c", "zz", "fresh", None, 7.0, 1, 1), (None, None, "nokey", None, 1.0, 1, 1)],
        "id string, sku_id string, name string, selling_points array<string>, price double, "
        "stock int, seq int")
    got = {r.sku_id: r for r in cat.product_upsert(existing, batch, 99).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].name, got["a"].selling_points, got["a"].price, got["a"].stock,
            got["a"].created_at_us, got["a"].updated_at_us) == ("new2", "z", 5.0, 3, 10, 99)
    assert (got["b"].name, got["b"].updated_at_us) == ("keep", 10)
    assert (got["c"].name, got["c"].created_at_us) == ("fresh", 99)


def test_retry_envelope_decoding(spark):
    msgs = ['{"event":{"user_id":"u1","event_type":"X"},"attempt":2,"next_retry_at":5,"last_error":"e"}',
            '{"event":"not an object","attempt":1}', 'garbage', '{"attempt":1}',
            '{"event":{"userId":"u2"}}']
    df = spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "i int, value string")
    got = {r.i: r for r in rty.decode_envelopes(df).collect()}
    assert (got[0].status, got[0].user_id, got[0].attempt, got[0].next_retry_at_ms) == ("ok", "u1", 2, 5)
    assert [got[i].status for i in (1, 2, 3)] == ["invalid"] * 3
    assert (got[4].user_id, got[4].attempt, got[4].next_retry_at_ms) == ("u2", 0, 0)
    due = rty.due(rty.decode_envelopes(df).filter("status = 'ok'"), now_ms=4)
    assert {r.i: r.due for r in due.collect()} == {0: False, 4: True}


def test_compound_cap_boundaries(spark):
    h = 3_600_000_000
    m = 60_000_000
    # gap rule: 59 min after a send is blocked, 60 min is allowed
    # count rule: sends at 0,1,2,3 h pass (3 earlier sends <= 3), the 4 h one sees 4 -> blocked;
    # at exactly 24 h the 0 h send has left the window (t - 24 h, t] -> allowed
    rows = [("g", 0, 1), ("g", 59 * m, 2), ("g", 60 * m, 3),
            ("c", 0, 10), ("c", 1 * h, 11), ("c", 2 * h, 12), ("c", 3 * h, 13), ("c", 4 * h, 14),
            ("c", 24 * h - 1, 15), ("c", 24 * h, 16)]
    df = spark.createDataFrame(rows, "user_id string, t_us long, event_id long")
    got = {r.event_id: r.allowed for r in gov.compound_gate(df).collect()}
    assert got == {1: True, 2: False, 3: True, 10: True, 11: True, 12: True, 13: True, 14: False,
                   15: False, 16: True}


def test_snapshot_lookup_malformed_is_null(spark):
    from intentlane.operators.context import snapshot_lookup
    snap = spark.createDataFrame(
        [("1", '{"id":1,"name":"a","spending_tier":"HIGH","identity_tags":["x"]}'), ("2", "oops"),
         ("3", "  "), ("4", "[1,2]"), ("5", None)], "key string, doc string")
    req = spark.createDataFrame([(k,) for k in "123456"], "request_id string")
    got = {r.request_id: r.cached for r in snapshot_lookup(req, snap).collect()}
    assert got["1"].spending_tier == "HIGH" and got["1"].identity_tags == ["x"]
    assert all(got[k] is None for k in "23456")


def test_activity_approximate_distinct_option(spark):
    as_of = 1_706_659_200_000_000
    rows = [("1", f"s{i % 7}", as_of - i * 1_000_000) for i in range(50)] + [("2", None, as_of - 5)]
    df = spark.createDataFrame(rows, "user_id string, sku_id string, t long") \
        .withColumn("event_time", F.timestamp_micros("t"))
    exact = {r.user_id: (r.total_clicks_30d, r.unique_products_viewed_30d)
             for r in activity(df, as_of, P.ACTIVITY_LOOKBACK_US).collect()}
    approx = {r.user_id: (r.total_clicks_30d, r.unique_products_viewed_30d)
              for r in activity(df, as_of, P.ACTIVITY_LOOKBACK_US, exact_distinct=False).collect()}
    assert exact == approx == {1: (50, 7), 2: (1, 0)}


def test_last_message_sent_rejects_blank_users(spark):
    sends = spark.createDataFrame([("u", 5), ("u", 9), (" ", 7), (None, 8)], "user_id string, t_us long")
    got = sorted((r.user_id or "", r.status, r.last_sent_us) for r in gov.last_message_sent(sends, 10).collect())
    assert got == [("", "error", None), (" ", "error", None), ("u", "success", 9)]


def test_promotion_eligibility_matches_brute_force(spark):
    from intentlane.operators.audit import promotion_eligibility
    spends = [None, -5.0, 0.0, 0.5, 1.0, 63.99, 64.0, 1e6, float("inf")]
    mins = [None, -10.0, -5.0, 0.0, 0.5, 1.0, 2.0, 63.0, 64.0, 64.01, 1e6, 1e300]
    mins += [10.0 + i / 1000 for i in range(12_000)]          # more rules than any list in a plan should hold
    users = spark.createDataFrame([(i, '["price_sensitive"]') for i in range(len(spends))] + [(99, '["vip"]'), (100, None)],
                                  "id long, identity_tags string")
    spend = spark.createDataFrame([*enumerate(spends), (99, 1e6), (100, 1e6)], "user_id long, spend double")
    rules = spark.createDataFrame(list(enumerate(mins)), "rule_id int, min_spend double")
    got = {(r.user_id, r.rule_id) for r in promotion_eligibility(users, spend, rules, parts=4).collect()}
    assert got == {(u, r) for u, s in enumerate(spends) for r, m in enumerate(mins)
                   if s is not None and m is not None and m <= s}
