"""DOC-3 as a stream: at every watermark the latest rows are the batch profile; users whose events expired leave it."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

from intentlane.operators.audit import realtime_profile
from intentlane.session import state_partitions
from intentlane.streaming.ordered import read_side_output, write_with_side_output
from intentlane.streaming.profile_stream import profiles_as_of, realtime_profile_stream

MINUTE = 60_000_000
SCHEMA = pa.schema([("user_id", pa.string()), ("event_id", pa.int64()), ("t_us", pa.int64()), ("sku_id", pa.string()), ("price", pa.float64())])


def test_stream_equals_batch_at_every_watermark(spark, tmp_dir):
    rnd = random.Random(6)
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    rows, marks = [], []
    for batch in range(6):
        start = batch * 40 * MINUTE
        part = [(rnd.choice("abcd") if batch < 4 else "d", 100 * batch + i, start + rnd.randrange(40 * MINUTE), rnd.choice(["s1", "s2", "s3", None]),
                 rnd.choice([1.0, 19.0, 50.0, None])) for i in range(40)]
        part.append(("z", 100 * batch + 99, start + 40 * MINUTE, "s1", 1.0))      # the latest of its batch: sets the watermark
        rnd.shuffle(part)
        rows += part
        marks.append(start + 40 * MINUTE - 10 * MINUTE)
        path = os.path.join(src, f"{batch}.parquet")
        pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, r)) for r in part], schema=SCHEMA), path)
        os.utime(path, (1000 + batch, 1000 + batch))
    ddl = "user_id string, event_id bigint, t_us bigint, sku_id string, price double"
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{src}/*.parquet")
    out = realtime_profile_stream(stream, 30 * MINUTE, watermark="10 minutes")
    with state_partitions(spark, 2):
        write_with_side_output(out, f"{tmp_dir}/out", f"{tmp_dir}/ckpt").trigger(availableNow=True).start().awaitTermination()
    emitted = read_side_output(spark, f"{tmp_dir}/out", "main", out.schema).cache()
    events = spark.createDataFrame(rows, ddl)
    cols = ("user_id", "last_active_us", "n_events_window", "price_sensitive", "realtime_interest")
    retracted = 0
    for mark in marks:
        got = sorted(tuple(r[c] for c in cols) for r in profiles_as_of(emitted, mark).collect())
        want = sorted(tuple(r[c] for c in cols) for r in realtime_profile(events, mark, 30 * MINUTE).collect())
        assert got == want
        retracted += 4 - len([r for r in got if r[0] in "abcd"])
    assert retracted >= 3       # users a, b and c have left
    assert emitted.where("n_events_window = 0").count() >= 3
