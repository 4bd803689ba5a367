"""RET-2, approximate path: a coarse-cell index, joined by cell with several
probes per query.

Cells are the nearest-centroid regions of a sample of the index's own vectors,
about one centroid per ``rows_per_cell`` rows, so cells keep their size as the
table grows and a query meets ``probes * rows_per_cell`` rows instead of all.
The centroids travel to every worker: their number is limited to
``MAX_CENTROID_BYTES`` of vectors (cells get larger beyond that). With many
cells a vector is first compared with the centroids' own coarse centres and
then only with the centroids below the nearest of them, so finding the cell
of a row costs about the square root of the number of cells. The
cells that a query visits are the nearest of all, found by one matrix product.

``probes`` follows from the data: for a bounded sample of queries the exact
neighbours are found, and the number of cells to visit is read off the ranks
of the cells that hold them. Visiting all cells is the exact search.

Index and queries meet by bins: neighbouring cells with about ``block_rows`` index
rows together. A query goes once to each bin that holds a cell it visits, with one
bit a cell, however many cells that are, and is compared there with the rows of
those cells alone, cell by cell if that is less than half of them. A cell of more rows is a bin of its own and is cut into blocks,
as are the queries of a bin, so neither a dense region nor a popular one is one
task, and no other bin is copied for it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentlane.functions.memory import give_back
from intentlane.operators.retrieval import FEW_BLOCKS, MORE_ROWS, knn, n_blocks, nearest_rows, vector_rows
from intentlane.session import ship_package
from intentlane.sources.tables import materialise

ROWS_PER_CELL = 5_000
MAX_CENTROID_BYTES = 64 << 20
FLAT_CELLS = 1_024            # up to here a vector is compared with every centroid
BEAM = 8                      # coarse centres whose cells are looked at, at least
CALIBRATION_QUERIES = 256     # queries whose exact neighbours set the probes
RECALL = 0.9
MARGIN = 0.04                 # aim above the wanted recall, as the sample is small
BIN_CELLS = 2_048             # cells of a bin, at most
SLICE_ROWS = 1_024            # vectors whose cells are looked for at once, and
SLICE_CELLS = 1 << 20         # cells that these have together


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


class Cells:
    """Centroids and, if there are many, a second level over them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = _unit(np.asarray(centroids, np.float32))
        self.centroids[~np.isfinite(self.centroids).all(axis=1)] = 0
        self.coarse: np.ndarray | None = None
        if len(centroids) > FLAT_CELLS:
            step = int(math.sqrt(len(centroids)))
            self.coarse = self.centroids[::step]
            home = np.concatenate([(self.centroids[k:k + 65_536] @ self.coarse.T).argmax(axis=1)
                                   for k in range(0, len(self.centroids), 65_536)])
            order = np.argsort(home, kind="stable")
            used, first = np.unique(home[order], return_index=True)     # of equal centres one has all cells
            self.coarse, self.members = self.coarse[used], np.split(order, first[1:])

    def __len__(self) -> int:
        return len(self.centroids)

    def similarity(self, vectors: np.ndarray) -> np.ndarray:
        """Of each vector to each centroid."""
        return _unit(vectors).astype(np.float32) @ self.centroids.T

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The cell that each vector belongs to: the nearest one, with two levels
        the nearest below the ``BEAM`` nearest coarse centres."""
        if self.coarse is None:
            return self.similarity(vectors).argmax(axis=1)
        vectors = _unit(vectors).astype(np.float32)
        near = vectors @ self.coarse.T
        beam = min(BEAM, len(self.coarse))
        wide = np.argpartition(-near, beam - 1, axis=1)[:, :beam]
        best, out = np.full(len(vectors), -np.inf, np.float32), np.zeros(len(vectors), np.int64)
        # all vectors that look below a coarse centre are compared with its centroids together
        by = np.argsort(wide, axis=None, kind="stable")
        edges = np.searchsorted(wide.ravel()[by], np.arange(len(self.coarse) + 1))
        for members, first, past in zip(self.members, edges[:-1], edges[1:]):
            if past > first:
                rows = by[first:past] // beam
                found = vectors[rows] @ self.centroids[members].T
                at = found.argmax(axis=1)
                found, cell = found[np.arange(len(rows)), at], members[at]
                better = (found > best[rows]) | ((found == best[rows]) & (cell < out[rows]))
                best[rows[better]], out[rows[better]] = found[better], cell[better]
        return out

    def visited(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """(vectors by cells, boolean) the ``n`` nearest cells of each vector, of equal ones the first."""
        similar = self.similarity(vectors)
        if n >= len(self):
            return np.ones(similar.shape, bool)
        least = np.partition(similar, len(self) - n, axis=1)[:, len(self) - n]
        on = similar >= least[:, None]
        for i in np.flatnonzero(np.count_nonzero(on, axis=1) > n).tolist():
            on[i, np.flatnonzero(similar[i] == least[i])[n - np.count_nonzero(similar[i] > least[i]):]] = False
        return on

    def nearest(self, vectors: np.ndarray, n: int) -> list[np.ndarray]:
        """The ``n`` nearest cells of each vector, nearest first, fewer if there are fewer."""
        return list(np.argsort(-self.similarity(vectors), axis=1, kind="stable")[:, :n])

    def ranks(self, vectors: np.ndarray, cells: list[list[int]]) -> list[np.ndarray]:
        """How many cells are visited before each of a vector's ``cells``."""
        out = []
        for similar, mine in zip(self.similarity(vectors), cells):
            turn = np.empty(len(self), np.int64)
            turn[np.argsort(-similar, kind="stable")] = np.arange(len(self))
            out.append(turn[np.asarray(mine, np.int64)])
        return out


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column that have ``dim`` finite components and a
    direction, and their row numbers."""
    vectors, rows = vector_rows(column, dim)
    good = np.isfinite(vectors).all(axis=1)
    return vectors[good], rows[good]


def _slices(batches: Iterator[pa.RecordBatch], each: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose rows have ``SLICE_CELLS`` cells together at
    ``each`` cells a row, so that memory follows neither the batch nor the cells."""
    step = max(1, min(SLICE_ROWS, SLICE_CELLS // max(1, each)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def fit_cells(index: DataFrame, i_id: str = "id", i_vec: str = "embedding", rows_per_cell: int = ROWS_PER_CELL) -> Cells:
    """Centroids from the index: the vectors whose id has the smallest hashes,
    so they are the same on every run."""
    sized = index.where(F.col(i_vec).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(i_vec)).alias("dim")).first()
    if not sized["n"] or not sized["dim"]:
        return Cells(np.zeros((1, 1), np.float32))
    most = max(1, MAX_CENTROID_BYTES // (4 * sized["dim"]))
    want = min(most, max(1, math.ceil(sized["n"] / rows_per_cell)))
    rows = (index.where(F.size(i_vec) == sized["dim"]).select(F.xxhash64(F.lit("cell"), F.col(i_id)).alias("h"), F.col(i_vec).alias("v"))
            .where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: F.isnan(x)))
            .orderBy("h", "v").limit(want).collect())
    return Cells(np.array([r["v"] for r in rows] or [[0.0] * sized["dim"]], np.float32))


def assign(df: DataFrame, cells: Cells, id_col: str, vec_col: str, n: int, out: tuple[str, str]) -> DataFrame:
    """(out id, out vector, cell), one row per vector and each of its ``n`` nearest cells; vectors without a direction have none."""
    sent = df.sparkSession.sparkContext.broadcast(cells)
    dim = cells.centroids.shape[1]
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, vec_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1 if n == 1 and cells.coarse is not None else len(cells)):
            vectors, rows = _matrix(batch["v"], dim)
            if n == 1:
                again, which = pa.array(rows, pa.int64()), sent.value.home(vectors).astype(np.int32)
            else:
                at, which = np.nonzero(sent.value.visited(vectors, n))
                again, which = pa.array(rows[at], pa.int64()), which.astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["i"].take(again), batch["v"].take(again), pa.array(which)], names=[*out, "cell"])

    return (df.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v"))
            .mapInArrow(run, f"{out[0]} {kinds[0]}, {out[1]} {kinds[1]}, cell int"))


def choose_probes(queries: DataFrame, index: DataFrame, placed: DataFrame, cells: Cells, k: int, q_id: str, i_id: str,
                  q_vec: str, i_vec: str, recall: float) -> int:
    """The cells to visit so that ``recall`` of the exact neighbours are met,
    measured on at most ``CALIBRATION_QUERIES`` queries drawn by hash: for a
    rising number of cells, how many exact neighbours lie in those that a
    query would visit. The driver gets one sum per number of cells."""
    sample = materialise(queries.select(F.col(q_id).alias("id"), F.col(q_vec).alias("embedding"))
                         .orderBy(F.xxhash64(F.lit("probe"), F.col(q_id))).limit(CALIBRATION_QUERIES), "ann-sample")
    exact = knn(sample, index, k, "id", i_id, "embedding", i_vec)
    homes = (exact.join(placed.select(F.col("_iid").alias("id"), F.col("cell").alias("_home")), "id")
             .groupBy("query_id").agg(F.collect_list("_home").alias("homes")))     # k cells a query
    tries = [1]
    while tries[-1] < len(cells):
        tries.append(min(len(cells), max(tries[-1] + 1, tries[-1] * 6 // 5)))
    sent = index.sparkSession.sparkContext.broadcast(cells)
    dim = cells.centroids.shape[1]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(sent.value)):
            vectors, rows = _matrix(batch["embedding"], dim)
            wanted = [batch["homes"][int(i)].as_py() for i in rows]
            ranks = np.sort(np.concatenate([*sent.value.ranks(vectors, wanted), np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(tries, pa.int32()), pa.array(np.searchsorted(ranks, tries), pa.int64()),
                                              pa.array([len(ranks)] * len(tries), pa.int64())], names=["n", "hits", "of"])

    joined = sample.join(homes, sample["id"] == homes["query_id"]).select("embedding", "homes")
    sums = joined.mapInArrow(met, "n int, hits bigint, of bigint").groupBy("n").agg(F.sum("hits").alias("hits"), F.sum("of").alias("of"))
    for r in sorted(sums.collect(), key=lambda r: r["n"]):
        if r["hits"] >= min(1.0, recall + MARGIN) * r["of"]:
            return r["n"]
    return len(cells)


@dataclass
class Bins:
    """Cells put together: the bin of each cell (-1: no index row) and the cell's
    place in it, and the blocks that a bin's rows are cut into."""
    of: np.ndarray
    place: np.ndarray
    blocks: np.ndarray

    @staticmethod
    def fit(cells: Cells, sizes: np.ndarray, block_rows: int) -> "Bins":
        order = np.arange(len(cells)) if cells.coarse is None else np.concatenate(cells.members)
        of, place, rows, inside = np.full(len(cells), -1, np.int32), np.zeros(len(cells), np.int32), [], 0
        for c in order[sizes[order] > 0].tolist():
            if not rows or rows[-1] + sizes[c] > block_rows or inside == BIN_CELLS:
                rows.append(0)
                inside = 0
            of[c], place[c] = len(rows) - 1, inside
            rows[-1] += int(sizes[c])
            inside += 1
        return Bins(of, place, np.array([math.ceil(r / block_rows) for r in rows], np.int32))

    def table(self, spark: SparkSession) -> DataFrame:
        """(cell, bin, place, _ibs) of the cells with rows, at most one row a centroid."""
        cell = np.flatnonzero(self.of >= 0)
        return spark.createDataFrame(pa.table({
            "cell": pa.array(cell, pa.int32()), "bin": pa.array(self.of[cell], pa.int32()), "place": pa.array(self.place[cell], pa.int32()),
            "_ibs": pa.array(self.blocks[self.of[cell]], pa.int32())}))


def ask(queries: DataFrame, cells: Cells, bins: Bins, id_col: str, vec_col: str, n: int) -> DataFrame:
    """(_qid, _qv, bin, visits): a row for each bin that holds one of a query's ``n``
    nearest cells; ``visits`` has a bit for each cell of the bin."""
    sent = queries.sparkSession.sparkContext.broadcast((cells, bins))
    dim = cells.centroids.shape[1]
    kinds = [queries.schema[c].dataType.simpleString() for c in (id_col, vec_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_, bins_ = sent.value
        used = np.flatnonzero(bins_.of >= 0)
        used = used[np.lexsort((bins_.place[used], bins_.of[used]))]
        edges = np.searchsorted(bins_.of[used], np.arange(len(bins_.blocks) + 1))
        for batch in _slices(batches, len(cells_)):
            vectors, rows = _matrix(batch["v"], dim)
            on = cells_.visited(vectors, n)[:, used]
            take, which, visits, sizes = [], [], [], []
            for b, (first, past) in enumerate(zip(edges[:-1], edges[1:])):
                bits = np.packbits(on[:, first:past], axis=1)
                hit = np.flatnonzero(bits.any(axis=1))
                take.append(rows[hit])
                which.append(np.full(len(hit), b, np.int32))
                visits.append(bits[hit].ravel())
                sizes.append(np.full(len(hit), bits.shape[1]))
            again = pa.array(np.concatenate([*take, np.zeros(0, np.int64)]), pa.int64())
            offsets = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(again), [None, pa.py_buffer(offsets), pa.py_buffer(
                np.concatenate([*visits, np.zeros(0, np.uint8)]))])
            yield pa.RecordBatch.from_arrays([batch["i"].take(again), batch["v"].take(again), pa.array(np.concatenate(
                [*which, np.zeros(0, np.int32)]), pa.int32()), packed], names=["_qid", "_qv", "bin", "visits"])

    return (queries.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v"))
            .mapInArrow(run, f"_qid {kinds[0]}, _qv {kinds[1]}, bin int, visits binary"))


def _bin_topk(k: int):
    """Each query's k nearest rows of one block of a bin, among the cells it visits."""
    def run(q: pa.Table, ix: pa.Table) -> pa.Table:
        give_back()
        qm, q_rows = vector_rows(q["_qv"])
        im, i_rows = vector_rows(ix["_iv"])
        q_ids, i_ids = q["_qid"].take(pa.array(q_rows)), ix["_iid"].take(pa.array(i_rows))
        row = at = np.zeros(0, np.int64)
        dist = np.zeros(0)
        if len(qm) and len(im):
            bits = np.frombuffer(b"".join(q["visits"].take(pa.array(q_rows)).to_pylist()), np.uint8).reshape(len(qm), -1)
            cell = ix["place"].to_numpy()[i_rows]
            by_id = pc.sort_indices(i_ids).to_numpy()
            by_cell = by_id[np.argsort(cell[by_id], kind="stable")]
            of_id = np.empty(len(by_id), np.int64)
            of_id[by_id] = np.arange(len(by_id))
            row, at, dist = nearest_rows(qm, im[by_cell], of_id[by_cell], k, bits, cell[by_cell])
            at = by_id[at]
        return pa.table({"_qid": q_ids.take(pa.array(row)), "_iid": i_ids.take(pa.array(at)), "_dist": pa.array(dist, pa.float64())})
    return run


def knn_approx(queries: DataFrame, index: DataFrame, k: int, q_id: str = "id", i_id: str = "id", q_vec: str = "embedding",
               i_vec: str = "embedding", recall: float = RECALL, probes: int | None = None,
               rows_per_cell: int = ROWS_PER_CELL, block_rows: int = 20_000) -> DataFrame:
    """The k nearest rows by cosine distance of every query, among the cells
    visited: query_id, id, distance, rank, as ``knn`` returns them. Vectors that
    are null, zero or hold NaN find nothing and are not found."""
    ship_package(queries.sparkSession)
    cells = fit_cells(index, i_id, i_vec, rows_per_cell)
    placed = materialise(assign(index, cells, i_id, i_vec, 1, ("_iid", "_iv")), "ann-index")
    if probes is None:
        probes = choose_probes(queries, index, placed, cells, k, q_id, i_id, q_vec, i_vec, recall)
    counted = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()     # at most one row a centroid
    sizes = np.zeros(len(cells), np.int64)
    sizes[[r["cell"] for r in counted]] = [r["n"] for r in counted]
    bins = Bins.fit(cells, sizes, min(MORE_ROWS * block_rows, max(block_rows, math.ceil(sizes.sum() / FEW_BLOCKS))))
    asked = materialise(ask(queries, cells, bins, q_id, q_vec, probes), "ann-queries")
    cuts = bins.table(queries.sparkSession)
    q_cuts = asked.groupBy("bin").agg(n_blocks(F.count(F.lit(1)), block_rows).alias("_qbs"))
    ix = (placed.join(F.broadcast(cuts), "cell").join(q_cuts, "bin")
          .select("bin", "place", "_iid", "_iv", F.pmod(F.xxhash64("_iid"), F.col("_ibs")).alias("_ib"),
                  F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_qbs") - 1)).alias("_qb")))
    qs = (asked.join(cuts.select("bin", "_ibs").distinct(), "bin").join(q_cuts, "bin")
          .select("bin", "visits", "_qid", "_qv", F.pmod(F.xxhash64("_qid"), F.col("_qbs")).alias("_qb"),
                  F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ibs") - 1)).alias("_ib")))
    out = T.StructType([T.StructField("_qid", queries.schema[q_id].dataType), T.StructField("_iid", index.schema[i_id].dataType),
                        T.StructField("_dist", T.DoubleType())])
    keys = ["bin", "_qb", "_ib"]
    local = qs.groupBy(*keys).cogroup(ix.groupBy(*keys)).applyInArrow(_bin_topk(k), schema=out)
    order = Window.partitionBy("_qid").orderBy(F.round("_dist", 9), F.col("_iid"))
    return (local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select(F.col("_qid").alias("query_id"), F.col("_iid").alias("id"), F.col("_dist").alias("distance"), "rank"))


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n_queries and the share of exact hits that were found."""
    hit = found.select("query_id", "id").distinct().withColumn("_hit", F.lit(1))
    return (exact.join(hit, ["query_id", "id"], "left")
            .agg(F.count_distinct("query_id").alias("n_queries"),
                 (F.count("_hit") / F.count(F.lit(1))).alias("recall")))
