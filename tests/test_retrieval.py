"""RET-1 unit norm, RET-2 against brute force, RET-6 fallback, RET-8 filter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from intentlane.operators import retrieval as ret


def test_embedding_unit_norm_and_determinism(spark):
    df = spark.createDataFrame([(1, "light strong cheap"), (2, "x" * 5000), (3, "")],
                               "id long, text string")
    a = {r.id: np.array(r.embedding) for r in ret.embed(df, "text").collect()}
    b = {r.id: np.array(r.embedding) for r in ret.embed(df, "text").collect()}
    for k in a:
        assert a[k].shape == (64,)
        assert np.allclose(a[k], b[k])
        assert abs(np.linalg.norm(a[k]) - 1.0) < 1e-5


def test_pandas_encoder_plugin(spark):
    def factory():
        return lambda texts: np.array([[len(t), 1.0, 0.0] for t in texts])
    enc = ret.pandas_encoder(factory, dim=3, cache_key="len-test")
    df = spark.createDataFrame([(1, "abc"), (2, "")], "id long, text string")
    got = {r.id: r.embedding for r in ret.embed(df, "text", encoder=enc).collect()}
    assert np.allclose(got[1], np.array([3, 1, 0]) / np.sqrt(10))


def _vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).astype(np.float32)
    return m


def test_knn_matches_brute_force_across_blocks(spark):
    q = _vectors(37, 8, 1)
    ix = _vectors(101, 8, 2)
    qdf = spark.createDataFrame([(i, q[i].tolist()) for i in range(len(q))], "id long, embedding array<float>")
    idf = spark.createDataFrame([(i, ix[i].tolist()) for i in range(len(ix))], "id long, embedding array<float>")
    got = ret.knn(qdf, idf, 5, block_rows=16).collect()   # several blocks per side
    qq, ii = q.astype(np.float64), ix.astype(np.float64)
    dist = 1 - (qq @ ii.T) / np.outer(np.linalg.norm(qq, axis=1), np.linalg.norm(ii, axis=1))
    want = {(i, int(j)) for i in range(len(q)) for j in np.lexsort((np.arange(len(ix)), np.round(dist[i], 9)))[:5]}
    assert {(r.query_id, r.id) for r in got} == want
    assert {r.rank for r in got} == {1, 2, 3, 4, 5}


def test_rerank_orders_by_score_and_falls_back(spark):
    rows = [(1, 1, 10, "red shoe", "blue hat"), (1, 2, 11, "red shoe", "red shoe"),
            (1, 3, 12, "red shoe", "red car"),
            (2, 1, 20, "a b", "a b"), (2, 2, 21, "a b", None)]
    df = spark.createDataFrame(rows, "query_id long, rank int, id long, query_text string, content string")
    scored = df.withColumn("score", ret.token_overlap_scorer(F.col("query_text"), F.col("content")))
    got = {(r.query_id, r.id): r.rank for r in ret.rerank(scored).collect()}
    assert (got[(1, 11)], got[(1, 12)], got[(1, 10)]) == (1, 2, 3)
    assert (got[(2, 20)], got[(2, 21)]) == (1, 2)      # a missing document keeps recall order


def test_script_search_filters_on_scenario(spark):
    v = _vectors(40, 4, 5)
    rows = [(i, "s" + str(i % 2), v[i].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, scenario string, embedding array<float>")
    got = ret.script_search(df, df, k=3).collect()
    assert all(r.scenario == "s" + str(r.query_id % 2) for r in got)
    assert len(got) == 40 * 3


def test_pandas_pair_scorer_plugin_and_failure(spark):
    rows = [(1, 1, 10, "q", "aa"), (1, 2, 11, "q", "aaaa"), (2, 1, 20, "q", "x"), (2, 2, 21, "q", None)]
    df = spark.createDataFrame(rows, "query_id long, rank int, id long, query_text string, content string")
    scorer = ret.pandas_pair_scorer(lambda: (lambda qs, ds: [len(d) for d in ds]), "len-pairs")
    got = {(r.query_id, r.id): r.rank for r in ret.rerank(
        df.withColumn("score", scorer(F.col("query_text"), F.col("content")))).collect()}
    assert (got[(1, 11)], got[(1, 10)]) == (1, 2)
    assert (got[(2, 20)], got[(2, 21)]) == (1, 2)


def test_knn_ties_break_by_id(spark):
    base = _vectors(6, 4, 9)
    ix = np.concatenate([base] * 5)                     # every vector five times
    order = np.random.default_rng(3).permutation(len(ix))
    ix = ix[order]
    idf = spark.createDataFrame([(int(i), ix[i].tolist()) for i in range(len(ix))],
                                "id long, embedding array<float>")
    qdf = spark.createDataFrame([(100 + i, base[i].tolist()) for i in range(6)],
                                "id long, embedding array<float>")
    got = ret.knn(qdf, idf, 7, block_rows=8).collect()
    ii, qq = ix.astype(np.float64), base.astype(np.float64)
    dist = 1 - (qq @ ii.T) / np.outer(np.linalg.norm(qq, axis=1), np.linalg.norm(ii, axis=1))
    for i in range(6):
        want = [int(j) for j in np.lexsort((np.arange(len(ix)), np.round(dist[i], 9)))[:7]]
        have = [r.id for r in sorted((r for r in got if r.query_id == 100 + i), key=lambda r: r.rank)]
        assert have == want


def test_ngrams_are_those_of_every_position(spark):
    """The encoder's vector against counts of all substrings of three characters, hashed alike."""
    from pyspark.ml.feature import HashingTF
    texts = ["", "ab", "abc", "light strong", "né\U0001f600x y", "a.b$c|d\\e\n f"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: np.array(r.embedding) for r in ret.embed(df, "text").collect()}
    grams = spark.createDataFrame([(i, [t[k:k + 3] for k in range(max(len(t) - 2, 1))]) for i, t in enumerate(texts)], "id int, g array<string>")
    for r in HashingTF(inputCol="g", outputCol="v", numFeatures=64).transform(grams).collect():
        want = r["v"].toArray()
        assert np.allclose(got[r["id"]], want / np.linalg.norm(want), atol=1e-6)


def test_nearest_rows_holds_small_tiles_and_breaks_ties_by_place():
    import tracemalloc
    import numpy as np
    rng = np.random.default_rng(3)
    index = rng.integers(-1, 2, size=(30_000, 4)).astype(float)     # many equal distances
    index[~index.any(axis=1), 0] = 1.0
    queries = index[:600].copy()
    tracemalloc.start()
    row, place, dist = ret.nearest_rows(queries, index, np.arange(len(index)), 9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20      # 256 queries by all rows took 300 MB
    for q in (0, 7, 300, 599):
        every = np.round(1.0 - index @ queries[q] / (np.linalg.norm(index, axis=1) * np.linalg.norm(queries[q])), 9)
        assert place[row == q].tolist() == np.lexsort((np.arange(len(index)), every))[:9].tolist()


def _brute(queries, index, place, k):
    dist = 1.0 - (queries @ index.T) / np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(index, axis=1))
    return [place[np.lexsort((place, np.round(d, 9)))[:k]].tolist() for d in dist]


def test_nearest_rows_scores_few_pairs_in_double_precision(monkeypatch):
    """Every pair was scored, divided and compared in float64."""
    scored, add, pairs = [0], ret._Best.add, getattr(ret._Best, "add_pairs", None)

    def count_add(self, queries, place, dist):
        scored[0] += dist.size
        return add(self, queries, place, dist)

    def count_pairs(self, q, at, found):
        scored[0] += len(q)
        return pairs(self, q, at, found)
    monkeypatch.setattr(ret._Best, "add", count_add)
    if pairs is not None:
        monkeypatch.setattr(ret._Best, "add_pairs", count_pairs)
    rng = np.random.default_rng(11)
    index, queries, place = rng.normal(size=(20_000, 16)), rng.normal(size=(600, 16)), rng.permutation(20_000)
    row, at, dist = ret.nearest_rows(queries, index, place, 9)
    assert [at[row == q].tolist() for q in range(600)] == _brute(queries, index, place, 9)
    assert scored[0] < len(index) * len(queries) / 100


def test_nearest_rows_tells_distances_apart_that_single_precision_does_not():
    rng = np.random.default_rng(12)
    turn = np.concatenate([[0.0], 1e-3 + 1e-5 * np.arange(5_999)])      # distances 1e-8 apart near 5e-7
    index = np.stack([np.cos(turn), np.sin(turn), np.zeros(6_000)], axis=1)[rng.permutation(6_000)]
    index *= rng.uniform(0.5, 2.0, size=(6_000, 1))
    queries, place = np.array([[1.0, 0.0, 0.0], [2.0, 0.0, 0.0]]), np.arange(6_000)
    row, at, dist = ret.nearest_rows(queries, index, place, 30)
    assert [at[row == q].tolist() for q in (0, 1)] == _brute(queries, index, place, 30)
    assert (np.diff(dist[row == 0]) > 1e-9).all()


@pytest.mark.parametrize("share", [0.02, 0.2, 0.8])
def test_nearest_rows_of_groups_with_odd_and_equal_vectors(share):
    rng = np.random.default_rng(13)
    index = rng.normal(size=(40, 6))[rng.integers(0, 40, 9_000)]       # every vector a few hundred times
    index[5_000:] = rng.normal(size=(4_000, 6))
    group, place = np.sort(rng.integers(0, 30, 9_000)), rng.permutation(9_000)
    queries, on = index[::15].copy(), rng.random((600, 30)) < share
    on[7] = False
    index[::97, 2] = np.nan
    row, at, dist = ret.nearest_rows(queries, index, place, 9, np.packbits(on, axis=1), group)
    for q in range(600):
        rows = np.flatnonzero(on[q][group])
        far = 1.0 - index[rows] @ queries[q] / (np.linalg.norm(index[rows], axis=1) * np.linalg.norm(queries[q]))
        far = np.where(np.isnan(far), np.inf, np.round(far, 9))
        assert at[row == q].tolist() == place[rows][np.lexsort((place[rows], far))[:9]].tolist()


def test_blocks_grow_with_a_large_table(spark):
    """A row is copied once a block of the other side: 30 times for 600,000 rows before."""
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 20_000, 50_000, 160_000, 400_000, 600_000, 60_000_000)], "n long")
    got = {r["n"]: r["b"] for r in sizes.select("n", ret.n_blocks(F.col("n"), 20_000).alias("b")).collect()}
    assert got == {0: 1, 1: 1, 20_000: 1, 50_000: 3, 160_000: 8, 400_000: 8, 600_000: 10, 60_000_000: 1_000}


def test_knn_with_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [0.5, 0.5]), (6, []), (None, [1.0, 0.1])]
    index = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = ret.knn(index.where("id in (1, 5)"), index, 9).collect()
    found = {(r["query_id"], r["id"]): r["distance"] for r in got}
    assert set(found) == {(q, i) for q in (1, 5) for i in (1, 4, 5, None)}
    assert found[1, 4] != found[1, 4] and found[1, 1] == 0.0        # no distance, and last
    assert max(got, key=lambda r: (r["query_id"], r["rank"]))["id"] == 4


def test_product_search_broadcasts_no_table(spark, tmp_dir):
    """The catalogue and the queries grow with the tables; a micro-batch sent each of them whole to the driver and all workers."""
    docs = spark.createDataFrame([(i, f"red item {i}", [float(i % 3) + 1.0, 1.0]) for i in range(1, 30)], "id long, document string, embedding array<float>")
    docs.write.parquet(f"{tmp_dir}/docs")
    docs = spark.read.parquet(f"{tmp_dir}/docs")
    meta = F.struct(F.col("id").cast("string").alias("product_id"), F.lit("n").alias("name"), F.lit("c").alias("category"),
                    F.lit("1.5").alias("price"), F.lit("a;b").alias("selling_points_str"))
    catalog = docs.select(F.col("id").cast("string").alias("id"), "document", meta.alias("metadata"))
    queries = docs.select("id", F.col("document").alias("query_text"), "embedding")
    out = ret.product_search(queries, docs.select("id", "embedding"), catalog)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.where("query_id = 4").orderBy("rank").collect()
    assert [r["id"] for r in rows] == [4, 1, 7] and rows[0]["price"] == 1.5
