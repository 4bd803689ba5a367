"""RTY-1..5 closed: the pending table is drained and refilled until every event has ended."""

import json

import pytest
from pyspark.sql import functions as F

from intentlane.operators.retry import decode_envelopes
from intentlane.streaming import retry_loop as R

ODD = '{"z":1,"a":[1.5,{"é":null}],"n":12345678901234567890,"user_id":"u"}'


def events(spark, rows):
    return spark.createDataFrame(rows, "event string, user_id string")


def loop(spark, base, fails=lambda attempt: F.lit(True), calls=None):
    def process(df):
        if calls is not None:
            calls.append(1)
        bad = fails(F.col("attempt"))
        return df.withColumn("success", ~bad).withColumn("error", F.when(bad, F.lit("e")))
    return R.RetryLoop(spark, base, process, bucket_ms=500)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_always_failing_event_dies_with_attempt_four(spark, tmp_dir):
    lp = loop(spark, tmp_dir)
    lp.ingest(events(spark, [(ODD, "u"), ('{"user_id":"v"}', "v")]), 0, 10_000)
    assert lp.run_until_empty(10_000) == 3
    assert rows(lp.outcome("dead_letter"), "event", "attempt", "failed_at_ms", "last_error", "source") == sorted(
        [(ODD, 4, 17_000, "e", "retry"), ('{"user_id":"v"}', 4, 17_000, "e", "retry")])
    assert lp.outcome("done").count() == 0 and lp.run_until_empty(99_000) == 0


def test_envelopes_keep_the_event_text(spark, tmp_dir):
    lp = loop(spark, tmp_dir)
    lp.ingest(events(spark, [(ODD, "u")]), 0, 1_000)
    (value,) = [r["value"] for r in lp.pending().collect()]
    assert value.startswith('{"event":' + ODD + ",") and json.loads(value)["next_retry_at"] == 2_000 and json.loads(value)["source"] == "main"
    back = decode_envelopes(spark.createDataFrame([(value,)], "value string")).first()
    assert (back["event"], back["attempt"], back["user_id"], back["status"]) == (ODD, 1, "u", "ok")


def test_nothing_is_taken_early_or_twice(spark, tmp_dir):
    lp = loop(spark, tmp_dir, lambda attempt: attempt < 2)
    lp.ingest(events(spark, [('{"k":1}', "a")]), 0, 1_000)      # due at 2000
    assert lp.drain(1_999)["n_retry"] == 0 and lp.outcome("done").count() == 0
    assert lp.drain(2_000)["n_retry"] == 1                      # due again at 4000
    assert lp.drain(3_999)["n_retry"] == 0
    # a batch of the main topic that failed at 500 is written only now: due long ago, and no round has seen it
    lp.ingest(events(spark, [('{"k":2}', "b")]), 1, 500)
    lp.drain(4_000)
    assert rows(lp.outcome("done"), "event", "attempt") == [('{"k":1}', 2)]
    lp.run_until_empty(4_000)
    assert rows(lp.outcome("done"), "event", "attempt") == [('{"k":1}', 2), ('{"k":2}', 2)]


def test_writers_and_rounds_can_run_again(spark, tmp_dir):
    calls = []
    lp = loop(spark, tmp_dir, lambda attempt: attempt < 1, calls)
    batch = events(spark, [('{"k":1}', "a"), ('{"k":2}', "b")])
    lp.ingest(batch, 0, 1_000)
    lp.ingest(batch, 0, 1_000)                  # the same micro-batch delivered again
    first = lp.drain(2_000)
    assert lp.drain(2_000, round_id=1) == first  # and the same round
    assert rows(lp.outcome("done"), "event", "attempt") == [('{"k":1}', 1), ('{"k":2}', 1)]
    with pytest.raises(RuntimeError):           # a round that fails half way commits nothing
        lp.ingest(events(spark, [('{"k":3}', "c")]), 1, 3_000)
        broken = loop(spark, tmp_dir, lambda attempt: attempt < 1)
        write = broken.spark.createDataFrame
        broken.spark = type("S", (), {"read": spark.read, "createDataFrame": staticmethod(lambda *a: (_ for _ in ()).throw(RuntimeError()) if a[1] == R.LOG else write(*a))})()
        broken.drain(5_000)
    assert len(rows(lp.outcome("done"), "event")) == 2
    assert lp.drain(5_000)["round"] == 2
    assert rows(lp.outcome("done"), "event", "attempt") == [('{"k":1}', 1), ('{"k":2}', 1), ('{"k":3}', 1)]


def test_broken_envelopes_end_as_invalid(spark, tmp_dir):
    lp = loop(spark, tmp_dir)
    lp.ingest(events(spark, [('{"k":1}', "a")]), 0, 1_000)
    bad = spark.createDataFrame([("x", "no json", 1_500, 3), ("y", '{"event":7}', 1_500, 3)], "key string, value string, next_retry_at_ms bigint, due bigint")
    bad.write.mode("append").partitionBy("due").parquet(f"{tmp_dir}/pending/writer=main-0")
    lp.run_until_empty(1_000)
    assert lp.outcome("invalid").count() == 2 and lp.outcome("dead_letter").count() == 1


def test_rounds_read_only_the_folders_that_are_due(spark, tmp_dir):
    lp = loop(spark, tmp_dir)
    lp.ingest(events(spark, [('{"k":1}', "a")]), 0, 1_000)
    lp.drain(2_000)
    plan = lp._due(9_000, 2_000, ["main-0"], ["round-1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "due" in plan.split("PartitionFilters")[1] and "writer" in plan.split("PartitionFilters")[1]
