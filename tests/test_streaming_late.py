"""INT-5 with rows in any order: within the watermark the result is that of the batch job, behind it rows go to the side output."""

import os
import random

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from intentlane import params as P
from intentlane.operators.intent import detect_high_intent, flatten_intents, with_time_us
from intentlane.session import state_partitions
from intentlane.sources import views as V
from intentlane.sources.streams import with_closing_row
from intentlane.streaming.intent_stream import detect_high_intent_stream
from intentlane.streaming.ordered import read_side_output, write_with_side_output

SF = "/root/testdata/sf0.001"
COLUMNS = ("user_id", "event_id", "t_us", "action", "sku_id", "price")


def _behavior(spark):
    return with_time_us(V.v_behavior(spark, SF)).select(*COLUMNS)


def _start(spark, path, base, watermark, closing):
    src = spark.readStream.schema(_behavior(spark).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*.parquet")
    out = detect_high_intent_stream(with_closing_row(src) if closing else src, P.TEST_INTENT, watermark)
    with state_partitions(spark, 3):
        q = write_with_side_output(out, f"{base}/out", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.schema, q


def _rows(df):
    return sorted((r.user_id, r.event_id, r.recent_clicks) for r in df.collect())


def _write(pdf, path, name):
    schema = pa.schema([("user_id", pa.string()), ("event_id", pa.int64()), ("t_us", pa.int64()), ("action", pa.string()), ("sku_id", pa.string()), ("price", pa.float64())])
    pq.write_table(pa.Table.from_pandas(pdf, schema=schema, preserve_index=False), os.path.join(path, name))


def test_any_order_within_the_watermark(spark, tmp_dir):
    rows = _behavior(spark).toPandas()
    path = os.path.join(tmp_dir, "src")
    os.makedirs(path)
    rnd = random.Random(1)
    parts = [rows[i::6].sample(frac=1, random_state=rnd.randrange(99)) for i in range(6)]
    for i, part in enumerate(parts[:3]):
        _write(part, path, f"{i}.parquet")
    schema, q = _start(spark, path, tmp_dir, "60 days", False)
    assert len(q.recentProgress) >= 3
    # the rest comes after a restart, with a closing row
    for i, part in enumerate(parts[3:]):
        _write(part, path, f"{i + 3}.parquet")
    closing = os.path.join(path, "z.parquet")
    last = rows.iloc[:1].assign(user_id="", t_us=7_258_118_400_000_000)
    _write(last, path, os.path.basename(closing))
    _start(spark, path, tmp_dir, "60 days", False)
    want = _rows(flatten_intents(detect_high_intent(V.v_behavior(spark, SF), P.TEST_INTENT)))
    assert _rows(read_side_output(spark, f"{tmp_dir}/out", "main", schema)) == want and want
    assert read_side_output(spark, f"{tmp_dir}/out", "late", schema).count() == 0


def test_rows_behind_the_watermark_leave_by_the_side(spark, tmp_dir):
    rows = _behavior(spark).toPandas().sort_values("t_us")
    path = os.path.join(tmp_dir, "src")
    os.makedirs(path)
    cut = rows["t_us"].quantile(0.5)
    early, rest = rows[rows["t_us"] <= cut], rows[rows["t_us"] > cut]
    held_back = early.sample(40, random_state=3)
    held_back = held_back[held_back["t_us"] < early["t_us"].max() - 3_600_000_000]
    _write(early.drop(held_back.index), path, "0.parquet")
    _write(rest, path, "1.parquet")
    _write(pd.concat([held_back, held_back.iloc[:1].assign(user_id="", event_id=-5, t_us=7_258_118_400_000_000)]), path, "2.parquet")
    for name, t in (("0", 1), ("1", 2), ("2", 3)):
        os.utime(os.path.join(path, f"{name}.parquet"), (t, t))
    schema, _ = _start(spark, path, tmp_dir, "1 hour", False)
    late = read_side_output(spark, f"{tmp_dir}/out", "late", schema).collect()
    assert sorted(r["event_id"] for r in late) == sorted(held_back["event_id"]) and len(late) > 20
    assert all(r["event_type"] is None and r["recent_clicks"] is None for r in late)
    on_time = spark.createDataFrame(rows.drop(held_back.index).astype(object).where(lambda x: x.notna(), None).values.tolist(), _behavior(spark).schema)
    want = _rows(flatten_intents(detect_high_intent(on_time.withColumn("event_time", F.timestamp_micros("t_us")).drop("t_us"), P.TEST_INTENT)))
    assert _rows(read_side_output(spark, f"{tmp_dir}/out", "main", schema)) == want


def test_closing_row_lets_everything_go(spark, tmp_dir):
    path = os.path.join(tmp_dir, "src")
    os.makedirs(path)
    _write(_behavior(spark).toPandas(), path, "0.parquet")
    schema, _ = _start(spark, path, tmp_dir, "1 hour", True)
    want = _rows(flatten_intents(detect_high_intent(V.v_behavior(spark, SF), P.TEST_INTENT)))
    assert _rows(read_side_output(spark, f"{tmp_dir}/out", "main", schema)) == want
