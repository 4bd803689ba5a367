"""RET-2 approximate path: recall against the exact search, and work per query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from intentlane.operators import ann
from intentlane.operators.retrieval import knn


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<float>")


def clustered(rng, n, groups, dim=16):
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(groups, size=n)] + 0.25 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("kind", ["clustered", "random", "hot"])
def test_recall(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "random":
        vectors = rng.normal(size=(600, 16))
    else:
        vectors = clustered(rng, 900, 12)
        if kind == "hot":       # a third of all rows in one spot, cut into blocks of 50
            vectors[:300] = vectors[0] + 0.01 * rng.normal(size=(300, 16))
    index = table(spark, vectors)
    queries = table(spark, vectors[::4] + 0.05 * rng.normal(size=vectors[::4].shape), 10_000)
    found = ann.knn_approx(queries, index, 5, rows_per_cell=40, block_rows=50)
    exact = knn(queries, index, 5)
    got = ann.recall_of(found, exact).first()
    assert got["n_queries"] == len(vectors[::4]) and got["recall"] >= 0.9
    right = {(r["query_id"], r["id"]): r["distance"] for r in exact.collect()}
    rows = found.collect()
    assert all(abs(right[r["query_id"], r["id"]] - r["distance"]) < 1e-9 for r in rows if (r["query_id"], r["id"]) in right)
    assert len({(r["query_id"], r["rank"]) for r in rows}) == len(rows) and max(r["rank"] for r in rows) <= 5


def test_all_cells_are_exact(spark):
    rng = np.random.default_rng(5)
    index = table(spark, rng.normal(size=(300, 8)))
    found = ann.knn_approx(index, index, 7, rows_per_cell=20, probes=15)
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert key(found) == key(knn(index, index, 7))


def test_work_grows_with_the_table_not_its_square(spark):
    """Pairs scored on four times the rows and queries, at the probes the data asks for."""
    def pairs(n):
        rng = np.random.default_rng(6)
        index = table(spark, clustered(rng, n, n // 50))
        cells = ann.fit_cells(index, rows_per_cell=50)
        placed = ann.assign(index, cells, "id", "embedding", 1, ("_iid", "_iv")).cache()
        probes = ann.choose_probes(index, index, placed, cells, 5, "id", "id", "embedding", "embedding", 0.9)
        asked = ann.assign(index, cells, "id", "embedding", probes, ("_qid", "_qv"))
        a, b = (x.groupBy("cell").count().withColumnRenamed("count", c) for x, c in ((placed, "a"), (asked, "b")))
        return a.join(b, "cell").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    small, large = pairs(600), pairs(2400)
    assert large < 8 * small


def test_two_levels_find_the_cell():
    rng = np.random.default_rng(7)
    cells = ann.Cells(clustered(rng, 3000, 60))
    assert cells.coarse is not None and sum(map(len, cells.members)) == 3000
    vectors = cells.centroids[::15] + 0.02 * rng.normal(size=(200, 16))
    flat = (ann._unit(vectors.astype(np.float32)) @ cells.centroids.T).argmax(axis=1)
    near = cells.nearest(vectors, 20)
    assert np.mean([n[0] == f for n, f in zip(near, flat)]) > 0.95
    assert all(len(n) == 20 and len(set(n.tolist())) == 20 for n in near)


def test_two_levels_visit_the_nearest_cells():
    """Below the nearest coarse centres lay only a part of the nearest cells of random vectors."""
    rng = np.random.default_rng(9)
    cells = ann.Cells(rng.normal(size=(3000, 16)))
    vectors = rng.normal(size=(50, 16)).astype(np.float32)
    turn = np.argsort(-(ann._unit(vectors) @ cells.centroids.T), axis=1, kind="stable")
    assert [n.tolist() for n in cells.nearest(vectors, 20)] == turn[:, :20].tolist()
    assert [np.flatnonzero(on).tolist() for on in cells.visited(vectors, 20)] == np.sort(turn[:, :20], axis=1).tolist()
    assert all((rank == np.arange(3000)).all() for rank in cells.ranks(vectors, turn.tolist()))


def test_equal_centroids():
    """Of equal cells the first holds the rows and is visited first."""
    cells = ann.Cells(np.tile(np.eye(4)[:2], (1500, 1)))
    vectors = np.array([[1.0, 0.1, 0.0, 0.0], [0.1, 1.0, 0.0, 0.0]])
    assert cells.coarse is not None and cells.home(vectors).tolist() == [0, 1]
    assert [np.flatnonzero(on).tolist() for on in cells.visited(vectors, 2)] == [[0, 2], [1, 3]]


def test_odd_vectors_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [0.5, 0.5]), (6, [1.0])]
    index = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {(r["query_id"], r["id"]) for r in ann.knn_approx(index, index, 9, probes=1).collect()}
    assert got == {(a, b) for a in (1, 5) for b in (1, 5)}
    assert ann.knn_approx(index.limit(0), index, 3).count() == 0
    assert ann.knn_approx(index, index.limit(0), 3).count() == 0


def test_a_query_travels_once_a_bin(spark):
    """Random vectors, so that most of many small cells are visited: what is sent follows the bins, not the cells."""
    rng = np.random.default_rng(8)
    index = table(spark, rng.normal(size=(600, 8)))
    cells = ann.fit_cells(index, rows_per_cell=10)
    placed = ann.assign(index, cells, "id", "embedding", 1, ("_iid", "_iv"))
    sizes = np.zeros(len(cells), np.int64)
    for r in placed.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    bins = ann.Bins.fit(cells, sizes, 200)
    rows = np.bincount(bins.of[bins.of >= 0], sizes[bins.of >= 0])
    assert rows.sum() == 600 and rows.max() <= 200 and len(rows) <= 6
    asked = ann.ask(index, cells, bins, "id", "embedding", 40).collect()
    assert len(asked) <= 600 * len(rows)        # 600 * 40 rows before
    bits = sum(bin(int.from_bytes(r["visits"])).count("1") for r in asked)
    assert bits == 600 * 40
    found = ann.knn_approx(index, index, 5, probes=len(cells), rows_per_cell=10, block_rows=150)
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert key(found) == key(knn(index, index, 5))
