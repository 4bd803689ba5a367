"""Streams against their batch jobs over several micro-batches (INT-5: test_streaming_late.py)."""

import os

from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.operators.intent import with_time_us
from intentlane.session import state_partitions
from intentlane.sources import views as V
from intentlane.streaming.ordered import write_with_side_output

SF = "/root/testdata/sf0.001"


def _split_by_day(spark, out_dir, days):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    for d in days:
        part = ev.filter(F.dayofmonth("ts") == d)
        part.coalesce(1).write.parquet(os.path.join(out_dir, f"day={d:02d}-files"))


def test_gate_stream_equals_batch(spark, tmp_dir):
    from intentlane.operators.governance import send_gate
    from intentlane.streaming.gate_stream import send_gate_stream
    from intentlane.sources.tables import read_table_stream
    src_dir = os.path.join(tmp_dir, "src")
    _split_by_day(spark, src_dir, range(1, 32))
    last = spark.read.parquet(f"{SF}/events.parquet").limit(1).withColumn("ts", F.lit("2200-01-01").cast("timestamp_ntz")) \
        .withColumn("event_type", F.lit("click")).withColumn("user_id", F.lit(-1).cast("bigint"))
    last.coalesce(1).write.parquet(f"{src_dir}/day=99-closing")     # moves the watermark past all days
    ev = read_table_stream(spark, f"{src_dir}/*/*.parquet", "event_id", "user_id", "event_type", "ts",
                           max_files_per_trigger=3)
    req = (ev.filter(F.col("event_type") == "click")
           .select("event_id", F.col("user_id").cast("string").alias("user_id"), "ts"))
    req = with_time_us(req, "ts").select("event_id", "user_id", "t_us")
    out = send_gate_stream(req, P.TEST_MESSAGE_LIMIT_US, watermark="30 days")
    base = os.path.join(tmp_dir, "gate")
    with state_partitions(spark, 3):
        q = write_with_side_output(out, f"{base}/out", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.event_id, r.allowed) for r in spark.read.parquet(f"{base}/out/main/batch=*").collect())
    breq = with_time_us(V.v_requests(spark, SF), "ts").select("event_id", "user_id", "t_us")
    want = sorted((r.event_id, r.allowed) for r in send_gate(breq, P.TEST_MESSAGE_LIMIT_US).collect())
    assert got == want


def test_retry_router_replay_is_idempotent(spark, tmp_dir):
    from intentlane.streaming.retry_stream import route_batch
    res = spark.createDataFrame(
        [(1, "u", 0, False, "boom"), (2, "u", 3, False, "x"), (3, "u", 1, True, None)],
        "event_id long, user_id string, attempt int, success boolean, error string")
    run = route_batch(tmp_dir, now_ms=1000)
    run(res, 7)
    run(res, 7)          # the same batch delivered again
    got = sorted((r.event_id, r.route) for r in spark.read.parquet(f"{tmp_dir}/*/batch=*").collect())
    assert got == [(1, "retry"), (2, "dead_letter"), (3, "done")]


def test_cart_abandon_stream_equals_batch(spark, tmp_dir):
    from intentlane.operators.audit import cart_abandon
    from intentlane.streaming.cart_stream import cart_abandon_stream
    src_dir = os.path.join(tmp_dir, "src")
    _split_by_day(spark, src_dir, range(1, 32))
    timeout = 2 * P.US_PER_DAY
    src = with_time_us(V.v_behavior(spark, SF, stream_path=f"{src_dir}/*/*.parquet",
                                    max_files_per_trigger=4))
    out = cart_abandon_stream(src, timeout)
    base = os.path.join(tmp_dir, "cart")
    with state_partitions(spark, 3):
        q = write_with_side_output(out, f"{base}/out", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(q.recentProgress) >= 4
    got = sorted(r.event_id for r in spark.read.parquet(f"{base}/out/main/batch=*").collect())
    b = with_time_us(V.v_behavior(spark, SF))
    wm_us = (b.agg(F.max("t_us")).first()[0] // 1000) * 1000
    want = sorted(r.event_id for r in cart_abandon(b, timeout, wm_us).collect())
    assert got == want and len(got) > 0


def test_fold_in_parts_equals_the_whole():
    import numpy as np
    from intentlane.streaming.intent_stream import _fold_sorted
    p = P.IntentParams(window_us=10, threshold=3, cooldown_us=20)
    t = np.array([0, 2, 4, 6, 8, 30, 31, 32, 33, 40, 41, 55, 56, 57], dtype=np.int64)
    n, fires, last, kept = _fold_sorted(np.zeros(0, dtype=np.int64), t, None, p)
    for cut in range(1, len(t)):
        n1, f1, l1, k1 = _fold_sorted(np.zeros(0, dtype=np.int64), t[:cut], None, p)
        n2, f2, l2, k2 = _fold_sorted(k1, t[cut:], l1, p)
        assert [*n1, *n2] == list(n) and [*f1, *(f + cut for f in f2)] == fires and l2 == last and list(k2) == list(kept)
