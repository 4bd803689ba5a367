"""Sources and sinks round trips (SRC-6, SRC-7, SNK-1..4, CAT-7)."""

import json
import os

from pyspark.sql import functions as F

from intentlane.operators import catalog as cat
from intentlane.operators import context as ctx
from intentlane.operators import retry as rty
from intentlane.operators.retrieval import embed
from intentlane.sources import sinks
from intentlane.sources import views as V
from intentlane.sources.tables import read_behavior_history, read_scripts_json, write_behavior_history

SF = "/root/testdata/sf0.001"


def test_scripts_json_array_round_trip(spark, tmp_dir):
    rows = [r.asDict() for r in V.v_scripts(spark, SF).select("scenario", "content", "tags").collect()]
    path = os.path.join(tmp_dir, "scripts.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2)
    got = read_scripts_json(spark, path)
    assert got.count() == len(rows)
    docs = cat.script_documents(got.withColumn("id", F.lit(1)))
    blank = sum(1 for r in rows if r["content"] is None or not r["content"].strip())
    assert docs.count() == len(rows) - blank


def test_history_partition_pruning(spark, tmp_dir):
    path = os.path.join(tmp_dir, "history")
    write_behavior_history(V.v_behavior(spark, SF), path)
    h = read_behavior_history(spark, path).filter(F.col("event_date") >= F.lit("2024-01-24").cast("date"))
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert h.count() == V.v_behavior(spark, SF).filter(
        F.to_date("event_time") >= F.lit("2024-01-24").cast("date")).count()


def test_snapshot_and_vector_upserts(spark, tmp_dir):
    snap = ctx.profile_snapshot(V.v_users(spark, SF))
    p = sinks.write_snapshot(snap, os.path.join(tmp_dir, "snap-v1"))
    back = spark.read.parquet(p)
    assert back.count() == V.v_users(spark, SF).count()
    docs = cat.catalog_for_index(V.v_products(spark, SF))
    vec = embed(docs, "document")
    v1 = sinks.upsert_vectors(vec, os.path.join(tmp_dir, "idx-v1"))
    changed = vec.limit(5).withColumn("document", F.lit("changed"))
    v2 = sinks.upsert_vectors(changed, os.path.join(tmp_dir, "idx-v2"), existing_path=v1)
    r = spark.read.parquet(v2)
    assert r.count() == vec.count()
    assert r.filter(F.col("document") == "changed").count() == 5


def test_intent_wire_format(spark):
    df = spark.createDataFrame([("7", 1, "high_interest_detected", "r", 5, ("view_item", "s", 1.0), 10)],
                               "user_id string, event_id long, event_type string, reason string, "
                               "event_time_us long, context struct<last_action:string,sku_id:string,price:double>, "
                               "recent_clicks long")
    row = sinks.intents_to_wire(df).collect()[0]
    payload = json.loads(row.value)
    assert row.key == "7" and payload["userId"] == "7" and payload["eventType"] == "high_interest_detected"
    assert payload["context"] == {"last_action": "view_item", "sku_id": "s", "price": 1.0}


def test_retry_envelopes(spark):
    res = spark.createDataFrame([(1, "u", 0, False, "boom"), (2, "u", 3, False, "x"), (3, "u", 0, True, None)],
                                "event_id long, user_id string, attempt int, success boolean, error string")
    routed = rty.route_results(res, 1000)
    env = {json.loads(r.value)["event"]["event_id"]: (r.route, json.loads(r.value))
           for r in sinks.retry_envelopes(routed, res).collect()}
    assert set(env) == {1, 2}
    assert env[1][0] == "retry" and env[1][1]["attempt"] == 1 and env[1][1]["next_retry_at"] == 2000
    assert env[1][1]["source"] == "main"
    assert env[2][0] == "dead_letter" and env[2][1]["attempt"] == 4 and env[2][1]["failed_at"] == 1000


def test_ingest_both(spark):
    existing = spark.createDataFrame([("a", "old", "p", 1.0, 1, 10, 10)],
                                     "sku_id string, name string, selling_points string, price double, "
                                     "stock int, created_at_us long, updated_at_us long")
    batch = spark.createDataFrame([("a", "new", ["x"], 150.0, 2, 1), ("b", "nb", None, None, None, 1)],
                                  "sku_id string, name string, selling_points array<string>, price double, "
                                  "stock int, seq int")
    table, vectors = cat.ingest_product_knowledge(existing, batch, 99)
    assert table.count() == 2
    v = {r.id: r for r in vectors.collect()}
    assert set(v) == {"a", "b"} and len(v["a"].embedding) == 64
    assert v["a"].metadata.selling_points_str == "x"


def test_dedupe_replayed_intents(spark, tmp_dir):
    from intentlane.sources.streams import dedupe_intents
    rows = [("u", 1, 100), ("u", 1, 100), ("u", 2, 200), ("v", 3, 100)]
    df = spark.createDataFrame(rows, "user_id string, event_id long, event_time_us long")
    assert dedupe_intents(df).count() == 3
    path = os.path.join(tmp_dir, "intents")
    df.write.parquet(path)
    s = spark.readStream.schema(df.schema).parquet(path)
    q = (dedupe_intents(s).writeStream.format("parquet").option("path", f"{path}-out")
         .option("checkpointLocation", f"{path}-ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(f"{path}-out").count() == 3
