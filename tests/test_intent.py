"""INT-1..4 boundaries, ties, both fold strategies, property test."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.operators.folds import greedy_cooldown
from intentlane.operators.intent import detect_high_intent, promotion_projection
from intentlane.operators.sliding import sliding_count
from tests.simulate import sorted_set_detector

W = P.WINDOW_US


def _events(spark, rows):
    return spark.createDataFrame(rows, "user_id string, t_us long, event_id long")


def _counts(df):
    return {r.event_id: r.n for r in df.collect()}


def test_window_lower_bound_is_exclusive(spark):
    t0 = 1_700_000_000_000_000
    df = _events(spark, [("u", t0, 1), ("u", t0 + W - 1, 2), ("u", t0 + W, 3)])
    c = _counts(sliding_count(df, ["user_id"], "t_us", "event_id", W))
    assert c == {1: 1, 2: 2, 3: 2}   # t0 drops out exactly at t0 + W


def test_ties_count_in_arrival_order(spark):
    t0 = 1_700_000_000_000_000
    df = _events(spark, [("u", t0, 5), ("u", t0, 3), ("u", t0, 9)])
    c = _counts(sliding_count(df, ["user_id"], "t_us", "event_id", W))
    assert c == {3: 1, 5: 2, 9: 3}


def test_bucket_edges_and_context_rows(spark):
    # bucket width = W * bucket_factor; events straddle several bucket edges
    rows = [("u", i * (W // 3), i) for i in range(60)]
    df = _events(spark, rows)
    got = _counts(sliding_count(df, ["user_id"], "t_us", "event_id", W, bucket_factor=2))
    want, _ = sorted_set_detector([(u, t, i) for u, t, i in rows], W, 10, P.COOLDOWN_US)
    assert got == want


def _behavior(spark, rows):
    """rows: (user, t_us, event_id) -> behaviour frame with event_time."""
    df = spark.createDataFrame(rows, "user_id string, t_us long, event_id long")
    return df.select("event_id", "user_id", F.lit("view_item").alias("action"),
                     F.lit("sku_1").alias("sku_id"), F.lit(9.5).alias("price"),
                     F.timestamp_micros("t_us").alias("event_time"))


def test_threshold_9_10_11(spark):
    t0 = 1_700_000_000_000_000
    for n, fires in ((9, 0), (10, 1), (11, 1)):
        rows = [("u", t0 + i * 1_000_000, i) for i in range(n)]
        out = detect_high_intent(_behavior(spark, rows), P.IntentParams()).collect()
        assert len(out) == fires
        if fires:
            assert out[0].event_id == 9 and out[0].recent_clicks == 10   # the 10th event fires
            assert out[0].reason == P.INTENT_REASON


def test_cooldown_not_extended_and_expires_exactly(spark):
    t0 = 1_700_000_000_000_000
    burst = [t0 + i for i in range(10)]                   # fires at t0 + 9
    fire = t0 + 9
    inside = [fire + P.COOLDOWN_US - 1 - i for i in range(10)]   # all inside the lock
    at_expiry = [fire + P.COOLDOWN_US + i for i in range(10)]
    times = sorted(burst + inside + at_expiry)
    rows = [("u", t, i) for i, t in enumerate(times)]
    out = detect_high_intent(_behavior(spark, rows), P.IntentParams(), chunk_cooldowns=1)
    got = sorted(r.event_time_us for r in out.collect())
    assert got == [fire, fire + P.COOLDOWN_US]
    out2 = detect_high_intent(_behavior(spark, rows), P.IntentParams())
    assert sorted(r.event_time_us for r in out2.collect()) == got


def test_projection_defaults(spark):
    df = spark.createDataFrame([("u", 1, 5, None, None, None)],
                               "user_id string, event_id long, t_us long, action string, sku_id string, price double")
    r = promotion_projection(df.withColumn("n", F.lit(10))).collect()[0]
    assert (r.context.last_action, r.context.sku_id, r.context.price) == ("unknown", "unknown", 0.0)
    assert r.event_type == "high_interest_detected"


def test_chunk_width_does_not_matter_with_hot_key(spark):
    import random
    rnd = random.Random(7)
    rows = []
    eid = 0
    for u in range(20):
        n = 2000 if u == 0 else 30    # user 0 holds most rows
        t = 0
        for _ in range(n):
            t += rnd.randint(1, 5 * 60_000_000)
            rows.append((f"u{u}", t, eid))
            eid += 1
    df = _events(spark, rows)
    a = {r.event_id for r in greedy_cooldown(df, ["user_id"], "t_us", "event_id", 3_600_000_000,
                                             chunk_cooldowns=1).collect()}
    b = {r.event_id for r in greedy_cooldown(df, ["user_id"], "t_us", "event_id", 3_600_000_000).collect()}
    _, want = sorted_set_detector(rows, 1, 1, 3_600_000_000)
    assert a == b == want


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", None, "b"]), st.integers(-20, 120)), min_size=1, max_size=120),
       st.integers(1, 9), st.integers(1, 4))
def test_greedy_cooldown_property(spark, evs, cooldown, width):
    rows = [(u, t, 2**60 + i) for i, (u, t) in enumerate(evs)]    # ties, null keys, ids beyond a double
    _, want = sorted_set_detector(rows, 1, 1, cooldown)
    df = _events(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")     # chunks run over batch ends
    try:
        got = greedy_cooldown(df, ["user_id"], "t_us", "event_id", cooldown, chunk_cooldowns=width).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.event_id for r in got} == want and len(got) == len(want)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 40)), min_size=1,
                max_size=80))
def test_property_matches_sorted_set(spark, evs):
    unit = 60_000_000
    rows = [(u, t * unit, i) for i, (u, t) in enumerate(evs)]
    p = P.IntentParams(window_us=5 * unit, threshold=3, cooldown_us=7 * unit)
    out = detect_high_intent(_behavior(spark, rows), p, chunk_cooldowns=2)
    counts, fired = sorted_set_detector(rows, p.window_us, p.threshold, p.cooldown_us)
    assert {r.event_id for r in out.collect()} == fired


def test_mark_col_any_chunk_width(spark):
    rows = [("u", i * 1_000_000, i) for i in range(50)] + [("v", i * 7_000_000, 100 + i) for i in range(20)]
    df = _events(spark, rows)
    _, want = sorted_set_detector(rows, 1, 1, 10_000_000)
    for width in (1, 3, 16):
        out = greedy_cooldown(df, ["user_id"], "t_us", "event_id", 10_000_000, mark_col="fired",
                              chunk_cooldowns=width).collect()
        assert len(out) == len(rows)
        assert {r.event_id for r in out if r.fired} == want, width


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 30)), min_size=1, max_size=60),
       st.integers(1, 3), st.integers(1, 7))
def test_sliding_count_property(spark, evs, factor, window):
    rows = [(u, t, i) for i, (u, t) in enumerate(evs)]          # many equal times -> ties
    df = _events(spark, rows)
    got = _counts(sliding_count(df, ["user_id"], "t_us", "event_id", window, bucket_factor=factor))
    want = {}
    for u, t, i in rows:
        # same key, time in (t - window, t], equal times only up to this row's arrival order
        want[i] = sum(1 for u2, t2, i2 in rows
                      if u2 == u and t - window < t2 <= t and (t2 < t or i2 <= i))
    assert got == want


def test_optional_action_filter(spark):
    t0 = 1_700_000_000_000_000
    rows = [("u", t0 + i * 1_000_000, i) for i in range(12)]
    df = spark.createDataFrame(rows, "user_id string, t_us long, event_id long").select(
        "event_id", "user_id",
        F.when(F.col("event_id") % 2 == 0, "view_item").otherwise("search").alias("action"),
        F.lit("s").alias("sku_id"), F.lit(1.0).alias("price"),
        F.timestamp_micros("t_us").alias("event_time"))
    assert detect_high_intent(df, P.IntentParams()).count() == 1          # all 12 count
    assert detect_high_intent(df, P.IntentParams(), actions=["view_item"]).count() == 0   # only 6
