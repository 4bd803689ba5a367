"""Embedding near-duplicates: recall against brute force, and exactness of what is linked."""

import numpy as np
from pyspark.sql import types as T

from __spark_entry__ import queries
from intentlane.llm.embedding_dedup import embedding_near_duplicates
from intentlane.session import ship_package

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("n_links", T.StringType()),
                       T.StructField("rid", T.StringType())])


def data():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(400, 64))
    vectors = [(v, int(rng.integers(3))) for v in base]
    for k in range(150):  # near copies around the limit: cosine about 0.97 to 1
        v, label = vectors[k]
        noise = rng.normal(size=64)
        noise -= noise @ v / (v @ v) * v
        noise *= np.linalg.norm(v) / np.linalg.norm(noise)
        tangent = rng.uniform(0, 0.25)
        vectors.append((2.0 * (v + tangent * noise), label if k % 10 else (label + 1) % 3))
    dense = rng.normal(size=64)  # a group of distinct near copies
    vectors += [(dense + rng.normal(size=64) * 0.06, 1) for _ in range(200)]
    rows = [(i, [float(np.float32(x)) for x in v], label, "x", "y") for i, (v, label) in enumerate(vectors)]
    rows += [(2000 + i, rows[3][1], rows[3][2], None, None) for i in range(60)]        # exact copies
    rows += [(2000, rows[3][1], rows[3][2], None, None), (None, rows[5][1], rows[5][2], None, None)]
    rows += [(3000, None, 1, None, None), (3001, [0.0] * 64, 1, None, None), (3002, [], 1, None, None),
             (3003, [float("nan")] * 64, 1, None, None), (3004, [float("inf")] + [0.0] * 63, 1, None, None),
             (3005, [None] + [1.0] * 63, 1, None, None), (3006, rows[3][1], None, None, None), (3007, [1.0, 2.0], 1, None, None),
             (3008, [2.0, 4.0], 1, None, None)]
    return rows


def brute(rows):
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1])
          and any(r[1]) for r in rows]
    links = set()
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1]), np.array(rows[j][1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    links.add((i, j))
    return links


def test_recall_and_exactness(spark):
    ship_package(spark)
    rows = data()
    links = brute(rows)
    got = embedding_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    degree = [0] * len(rows)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    found = 0
    for n, row in enumerate(rows):
        r = by_id[row[0]][0]
        assert r["n_links"] <= degree[n]
        found += r["n_links"]
        if degree[n] == 0:
            assert r["n_links"] == 0 and r["component_id"] == row[0] and r["kept"]
    assert found >= 0.97 * sum(degree)
    for i, r in ((3, by_id[3][0]), (2000, by_id[2000][0])):  # 62 equal vectors
        assert r["n_links"] >= 61
    assert by_id[None][0]["component_id"] == 5
    assert {r["component_id"] for r in by_id[2000]} == {by_id[3][0]["component_id"]}
    assert all(by_id[i][0]["n_links"] == 0 for i in range(3000, 3007))
    assert by_id[3007][0]["n_links"] == by_id[3008][0]["n_links"] == 1 and by_id[3008][0]["component_id"] == 3007
    for r in got:
        assert r["kept"] == (r["vec_id"] == r["component_id"])


def test_empty_table(spark):
    ship_package(spark)
    assert embedding_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_registered_query_finds_links_of_every_cosine_band(spark, tmp_dir):
    ship_package(spark)
    rng = np.random.default_rng(21)
    rows, cosine = [], {}
    for k in range(600):  # pairs of unequal vectors, half of them at the limit
        v = rng.normal(size=64)
        noise = rng.normal(size=64)
        noise -= noise @ v / (v @ v) * v
        noise *= np.linalg.norm(v) / np.linalg.norm(noise)
        want = rng.uniform(0.9801, 0.985) if k % 2 else rng.uniform(0.985, 0.999)
        pair = [np.float32(x) for x in (v, v + noise * np.sqrt(1 / want**2 - 1))]
        rows += [(2 * k + i, [float(x) for x in p], 1) for i, p in enumerate(pair)]
        x, y = (p.astype(np.float64) for p in pair)
        cosine[2 * k] = x @ y / (np.linalg.norm(x) * np.linalg.norm(y))
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_dir}/embeddings.parquet")
    got = {r["vec_id"]: r["n_links"] for r in queries()["op9_embedding_dedup"](spark, tmp_dir).collect()}
    links = brute(rows)
    assert len(got) == len(rows) and links == {(i, i + 1) for i in cosine}
    for low, high in ((0.98, 0.985), (0.985, 1.0)):
        found = [got[i] for i, c in cosine.items() if low <= c < high]
        assert len(found) > 250 and sum(found) >= 0.9 * len(found), (low, sum(found), len(found))
