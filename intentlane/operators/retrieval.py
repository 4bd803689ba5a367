"""RET-1..9: batch embedding, exact k-NN by cosine distance, metadata
pre-filter, hit shaping, re-ranking, product / script search and result
rendering, for whole tables of queries.

k-NN plan (RET-2). Exact top-k must score every (query, candidate) pair,
but pairs are never materialised as rows: queries and index rows are cut
into blocks of about ``block_rows`` rows, up to three times that in large
tables (the block counts are scalar subqueries over the table sizes, evaluated
inside the job), each (query block, index block) pair meets in one cogroup
task and only each query's local top-k leaves it. Matrix products score a small
tile at a time in float32; the pairs that their error bound leaves in question
are scored in float64, which alone decides order and distances. One window per
query keeps the global top-k of at most ``index_blocks * k`` candidates. Every
group is bounded whatever the data size, and no side is broadcast.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentlane import params as P
from intentlane.session import ship_package
from intentlane.functions.memory import give_back
from intentlane.functions.text import is_blank, split_selling_points
from intentlane.sources.tables import by_key

Encoder = Callable[[DataFrame, str, str], DataFrame]
DEFAULT_DIM = 64


# --------------------------------------------------------------------- RET-1
def hashed_ngram_encoder(dim: int = DEFAULT_DIM, n: int = 3) -> Encoder:
    """Default encoder: character n-grams of the whole text, hashed into
    ``dim`` buckets (Spark ML HashingTF, JVM side), L2-normalised. Needs no
    model files."""

    def encode(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        txt = F.coalesce(F.col(text_col), F.lit(""))
        # cut into characters once: a substring per position would walk the text from its start each time
        chars = F.filter(F.split(txt, ""), lambda c: c != "")
        df = df.withColumn("_chars", chars)
        grams = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("_chars") - F.lit(n - 1), F.lit(1))),
            lambda i: F.concat(*[F.coalesce(F.get("_chars", i + F.lit(k - 1)), F.lit("")) for k in range(n)]))
        staged = df.withColumn("_grams", grams)
        tf = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=dim)
        norm = Normalizer(inputCol="_tf", outputCol="_vec", p=2.0)
        out = norm.transform(tf.transform(staged))
        return (out.withColumn(out_col, vector_to_array("_vec", "float32"))
                .drop("_chars", "_grams", "_tf", "_vec"))

    return encode


_MODEL_CACHE: dict = {}


def pandas_encoder(model_factory: Callable[[], Callable[[list[str]], np.ndarray]],
                   dim: int, cache_key: str) -> Encoder:
    """Plug-in path for a real model: ``model_factory`` is called once per
    Python worker (cached by ``cache_key``) and maps a batch of texts to a
    (rows, dim) array; vectors are L2-normalised. Arrow batches, never rows."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _MODEL_CACHE.get(cache_key)
        if model is None:
            model = _MODEL_CACHE[cache_key] = model_factory()
        for texts in batches:
            mat = np.asarray(model(texts.fillna("").tolist()), dtype=np.float64).reshape(-1, dim)
            norms = np.linalg.norm(mat, axis=1, keepdims=True)
            mat = np.divide(mat, norms, out=np.zeros_like(mat), where=norms > 0)
            yield pd.Series(list(mat.astype(np.float32)))

    def encode(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        ship_package(df.sparkSession)
        return df.withColumn(out_col, _embed(F.col(text_col)))

    return encode


def embed(df: DataFrame, text_col: str, out_col: str = "embedding",
          encoder: Encoder | None = None) -> DataFrame:
    """RET-1: one vector per row, order and keys preserved."""
    return (encoder or hashed_ngram_encoder())(df, text_col, out_col)


# --------------------------------------------------------------------- RET-2
SLICE_QUERIES = 256           # queries and
TILE_ROWS = 4_096             # index rows that are compared at once,
FIRST_ROWS = 512              # at first fewer, which give a bound for the next
PAIRS = 16_384                # pairs whose exact distances are computed at once
SPARSE = 0.5                  # queries that look at a smaller share of the groups are compared group by group,
GROUP_QUERIES = 8_192         # so many at a time
DENSE = 16                    # a tile with more than one pair in so many to look at is computed exactly as a whole
FEW_BLOCKS, MORE_ROWS = 8, 3  # beyond so many blocks a side, blocks grow up to so many times ``block_rows``


def n_blocks(rows: Column, block_rows: int) -> Column:
    """The blocks that a table of ``rows`` rows is cut into. Each row of one side
    is copied once a block of the other, so a large table has fewer and larger ones."""
    def cut(size: int) -> Column:
        return F.ceil(rows / F.lit(size)).cast("long")
    return F.greatest(F.lit(1).cast("long"), F.least(F.lit(FEW_BLOCKS).cast("long"), cut(block_rows)), cut(MORE_ROWS * block_rows))


def vector_rows(column: pa.ChunkedArray | pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column that are not null and not zero, in the column's
    own float type (others in float64), and their row numbers. With ``dim`` those of
    that many components, else all must have the same number. Null components are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    if not pa.types.is_float32(values.type):
        values = values.cast(pa.float64())
    values = values.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes)
    if len(rows):
        some = np.logical_or.reduceat(values != 0, (np.cumsum(sizes) - sizes)[rows])
        if dim is not None:
            some &= sizes[rows] == dim
        if not some.all():
            values, rows = values[np.repeat(some, sizes[rows])], rows[some]
    if not len(rows):
        return np.zeros((0, dim or 0)), rows
    width = int(sizes[rows[0]])
    if (sizes[rows] != width).any():
        raise ValueError("vectors have different numbers of components")
    return values.reshape(-1, width), rows


class _Best:
    """The k nearest rows met so far of some queries, by (distance rounded to
    1e-9, place of the row)."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.key = np.full((n, k), np.inf)
        self.place = np.full((n, k), np.iinfo(np.int64).max)
        self.dist = np.full((n, k), np.nan)

    def add(self, queries: np.ndarray, place: np.ndarray, dist: np.ndarray) -> None:
        """Distances of the ``queries`` (numbers, one a row of ``dist``) to the rows at
        ``place``; infinite ones are of rows that the query does not look at."""
        reach = self.key[queries, -1]
        if np.isinf(reach).any() and dist.shape[1] > self.k:     # a first bound from the rows at hand
            reach = np.minimum(reach, np.partition(dist, self.k - 1, axis=1)[:, self.k - 1])
        row, column = np.nonzero(dist <= (reach + 1e-9)[:, None])
        self.add_pairs(queries[row], place[column], dist[row, column])

    def add_pairs(self, q: np.ndarray, at: np.ndarray, found: np.ndarray) -> None:
        """Distances of pairs of a query (its number) and the row at a place."""
        key, last = np.round(found, 9), self.key[q, -1]
        better = (key < last) | ((key == last) & (at < self.place[q, -1]))
        better &= ~np.isposinf(found)
        if not better.any():
            return
        self._merge(q[better], key[better], at[better], found[better])

    def add_without_distance(self, queries: np.ndarray, place: np.ndarray) -> None:
        """Rows whose distance is not a number come after all others."""
        q, at = np.repeat(queries, len(place)), np.tile(place, len(queries))
        self._merge(q, np.full(len(q), np.inf), at, np.full(len(q), np.nan))

    def _merge(self, q: np.ndarray, key: np.ndarray, place: np.ndarray, dist: np.ndarray) -> None:
        hit = np.unique(q)
        q = np.concatenate([q, np.repeat(hit, self.k)])
        key, place, dist = (np.concatenate([new, held[hit].ravel()])
                            for new, held in ((key, self.key), (place, self.place), (dist, self.dist)))
        order = np.lexsort((place, key, q))
        first = np.searchsorted(q[order], hit)      # every query met has k places at least
        take = order[(first[:, None] + np.arange(self.k)[None, :])]
        self.key[hit], self.place[hit], self.dist[hit] = key[take], place[take], dist[take]


def _norms(vectors: np.ndarray) -> np.ndarray:
    out = np.empty(len(vectors))
    for s in range(0, len(vectors), TILE_ROWS):
        part = vectors[s:s + TILE_ROWS].astype(np.float64)
        out[s:s + TILE_ROWS] = np.sqrt((part * part).sum(axis=1))
    return out


def _units(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    out = np.empty(vectors.shape, np.float32)
    for s in range(0, len(vectors), TILE_ROWS):
        np.divide(vectors[s:s + TILE_ROWS], norms[s:s + TILE_ROWS, None], out=out[s:s + TILE_ROWS], casting="same_kind")
    return out


def _kth_largest(near: np.ndarray, k: int) -> np.ndarray:
    """A value that k of each row's entries reach: the k-th largest of the greatest
    entries of disjoint sets of columns, or of all entries if they are few."""
    each = 16 if near.shape[1] >= 64 * k else 1
    if near.shape[1] < k:
        return np.full(len(near), -np.inf)
    sets = near.shape[1] // each
    if each > 1:
        near = near[:, :sets * each].reshape(len(near), each, sets).max(axis=1)
    return np.partition(near, sets - k, axis=1)[:, sets - k].astype(np.float64)


class _Pairs:
    """Vectors of both sides with what nearest_rows has found of them."""

    def __init__(self, qm: np.ndarray, im: np.ndarray, place: np.ndarray, k: int, group: np.ndarray | None):
        self.qm, self.im, self.place, self.group = qm, im, place, group
        self.qn, self.inn = _norms(qm), _norms(im)
        self.odd = not (np.isfinite(self.qn).all() and np.isfinite(self.inn).all())
        self.best = _Best(len(qm), k)

    def distances(self, q: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Exact distances of pairs of a query and a row."""
        out = np.empty(len(q))
        for s in range(0, len(q), PAIRS):
            a, b = q[s:s + PAIRS], row[s:s + PAIRS]
            dot = np.einsum("ij,ij->i", self.qm[a].astype(np.float64), self.im[b].astype(np.float64))
            out[s:s + PAIRS] = 1.0 - dot / (self.qn[a] * self.inn[b])
        return out

    def all_pairs(self, queries: np.ndarray, rows: np.ndarray, seen: np.ndarray | None) -> None:
        """Exact distances of all pairs; of each query's groups only with ``seen`` (queries by groups)."""
        if not len(queries) or not len(rows):
            return
        dist = self.qm[queries].astype(np.float64) @ self.im[rows].astype(np.float64).T
        with np.errstate(invalid="ignore", divide="ignore"):
            dist /= np.outer(self.qn[queries], self.inn[rows])
        np.subtract(1.0, dist, out=dist)
        if seen is not None:
            dist[~seen[:, self.group[rows]]] = np.inf
        if self.odd:
            for i in np.flatnonzero(np.isnan(dist).any(axis=1)).tolist():
                self.best.add_without_distance(queries[i:i + 1], self.place[rows[np.isnan(dist[i])]])
            dist[np.isnan(dist)] = np.inf
        self.best.add(queries, self.place[rows], dist)

    def plain_pairs(self, mine: np.ndarray, rows: np.ndarray, unit: np.ndarray, seen: np.ndarray | None, by_group: bool = False) -> None:
        """The same for rows and queries of finite length by single-precision products of
        unit vectors (``unit``: those of the rows). Their error has a bound, and only pairs
        that can be among the k nearest within it get an exact distance. ``by_group`` takes
        a group at a time with the queries that look at it, for queries that look at few."""
        near = _units(self.qm[mine], self.qn[mine])
        room = 2 * (near.shape[1] + 4) * 2.0 ** -23 + 2e-9
        bound = np.full(len(mine), -np.inf)         # each query has met k rows that are as similar
        most = SLICE_QUERIES * TILE_ROWS            # pairs compared at once
        sims, above = np.empty(most, np.float32), np.empty(most, bool)
        held, waiting, tiles, wait = [], 0, 0, max(8 * PAIRS, 32 * len(mine))

        def exact() -> None:
            for q, at, _ in held:
                self.best.add_pairs(mine[q], self.place[at], self.distances(mine[q], at))
            held.clear()
            np.maximum(bound, 1.0 - self.best.key[mine, -1], out=bound)

        def tiles_of() -> Iterator[tuple]:
            """(rows, their unit vectors, queries that look at some of them or None for all, whether they look at all of them)"""
            cuts = np.array([0, *itertools.takewhile(lambda t: t < min(len(rows), TILE_ROWS), (FIRST_ROWS << n for n in itertools.count())),
                             *range(TILE_ROWS, len(rows), TILE_ROWS), len(rows)])
            if by_group:
                cuts = np.unique(np.concatenate([cuts[cuts % TILE_ROWS == 0], [len(rows)], np.flatnonzero(np.diff(self.group[rows])) + 1]))
            for t, past in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                some, tile, who = rows[t:past], unit[t:past], None
                if seen is not None:
                    low = self.group[some[0]]
                    part = seen[:, low:self.group[some[-1]] + 1]
                    who = np.flatnonzero(part[:, 0] if by_group else part.any(axis=1))
                    if not by_group and 2 * np.count_nonzero(met := part.any(axis=0)) < len(met):
                        keep = met[self.group[some] - low]
                        some, tile = some[keep], tile[keep]
                    for c in range(0, len(who) if len(some) else 0, step := most // max(1, len(some))):
                        yield some, tile, None if len(who) == len(mine) <= step else who[c:c + step], by_group
                else:
                    yield some, tile, None, True

        for some, tile, who, whole in tiles_of():
            looks = None if whole else seen if who is None else seen[who]
            n = len(mine) if who is None else len(who)
            sim = np.matmul(near if who is None else near[who], tile.T, out=sims[:n * len(some)].reshape(n, -1))
            least = (bound if who is None else bound[who]) - room
            new = np.flatnonzero(np.isinf(least))   # queries that have not met k rows
            if len(new):
                first = sim if len(new) == n else sim[new]
                if looks is not None:
                    first[~looks[new][:, self.group[some]]] = -np.inf
                    sim[new] = first
                least[new] = np.maximum(_kth_largest(first, self.best.k) - room, -2.0)
            hit = np.flatnonzero(np.greater_equal(sim, least.astype(np.float32)[:, None], out=above[:sim.size].reshape(sim.shape)))
            row, column = np.divmod(hit, len(some))
            if looks is not None:
                looked = looks[row, self.group[some[column]]]
                hit, row, column = hit[looked], row[looked], column[looked]
            if who is not None:
                row = who[row]
            if len(hit) > max(sim.size // DENSE, 2 * n * self.best.k):
                self.all_pairs(mine if who is None else mine[who], some, looks)
                np.maximum(bound, 1.0 - self.best.key[mine, -1], out=bound)
            else:
                held.append((row, some[column], sim.ravel()[hit]))
                waiting += len(hit)
            tiles += 1
            if held and (tiles & (tiles - 1) == 0 or waiting > wait):
                q, at, found = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(4.0 * q - found)     # by query, the most similar first
                q, at, found = q[order], at[order], found[order]
                kth = np.searchsorted(q, np.arange(len(mine))) + self.best.k - 1
                full = np.flatnonzero(kth < np.searchsorted(q, np.arange(len(mine)), side="right"))
                bound[full] = np.maximum(bound[full], found[kth[full]])
                keep = found >= bound[q] - room
                held, waiting = [(q[keep], at[keep], found[keep])], np.count_nonzero(keep)
                if waiting > wait:
                    exact()
                    waiting = 0
        if held:
            q, at, found = (np.concatenate(x) for x in zip(*held))
            keep = found >= bound[q] - room
            held[:] = [(q[keep], at[keep], found[keep])]
            exact()


def nearest_rows(qm: np.ndarray, im: np.ndarray, place: np.ndarray, k: int, visits: np.ndarray | None = None,
                 group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, place, cosine distance) of each query's k nearest rows by
    (distance rounded to 1e-9, place). Matrix products of SLICE_QUERIES queries and
    TILE_ROWS rows, so memory does not follow the size of either side. Distances are
    float64; a single-precision product with a bound on its error rules out most pairs.

    With ``visits`` (a row of packed bits for each query, one bit a group) and ``group``
    (of each row, rising) a query looks at the rows of its groups only."""
    pairs = _Pairs(qm, im, place, k, group)
    plain_q, plain_i = (np.isfinite(n) & (n > 0) for n in (pairs.qn, pairs.inn))
    turn, rows = np.flatnonzero(plain_q), np.flatnonzero(plain_i)
    size, by_group = SLICE_QUERIES, False
    if visits is not None:      # queries that look at the same groups are near each other
        first = np.concatenate([np.unpackbits(visits[s:s + SLICE_QUERIES], axis=1).argmax(axis=1)
                                for s in range(0, len(visits), SLICE_QUERIES)] or [turn])
        turn = turn[np.argsort(first[turn], kind="stable")]
        looked = np.bitwise_count(visits).sum(dtype=np.int64) / max(1, len(visits) * (group.max(initial=-1) + 1))
        if looked < SPARSE:
            size, by_group = GROUP_QUERIES, True
    unit = _units(im if plain_i.all() else im[rows], pairs.inn[rows])
    for s in range(0, len(turn), size) if len(rows) else ():
        mine = turn[s:s + size]
        seen = None if visits is None else np.unpackbits(visits[mine], axis=1).view(bool)
        pairs.plain_pairs(mine, rows, unit, np.asfortranarray(seen) if by_group else seen, by_group)
    for queries, others in ((np.flatnonzero(~plain_q), np.arange(len(im))), (turn, np.flatnonzero(~plain_i))):
        for s in range(0, len(queries), SLICE_QUERIES) if len(others) else ():
            mine = queries[s:s + SLICE_QUERIES]
            seen = None if visits is None else np.unpackbits(visits[mine], axis=1).view(bool)
            for t in range(0, len(others), TILE_ROWS):
                pairs.all_pairs(mine, others[t:t + TILE_ROWS], seen)
    best = pairs.best
    row, column = np.nonzero(best.place < np.iinfo(np.int64).max)
    return row, best.place[row, column], best.dist[row, column]


def _local_topk(k: int):
    """Each query's k nearest rows of one (query block, index block)."""
    def run(q: pa.Table, ix: pa.Table) -> pa.Table:
        give_back()
        # a missing or zero vector has no direction: it is neither found nor finds anything
        qm, q_rows = vector_rows(q["_qv"])
        im, i_rows = vector_rows(ix["_iv"])
        q_ids, i_ids = q["_qid"].take(pa.array(q_rows)), ix["_iid"].take(pa.array(i_rows))
        order = pc.sort_indices(i_ids).to_numpy()      # of equal distances the smallest ids
        row, at, dist = nearest_rows(qm, im[order], np.arange(len(im)), k) if len(qm) and len(im) else (np.zeros(0, np.int64),) * 3
        return pa.table({"_qid": q_ids.take(pa.array(row)), "_iid": i_ids.take(pa.array(order[at])), "_dist": pa.array(dist, pa.float64())})
    return run


def knn(queries: DataFrame, index: DataFrame, k: int, q_id: str = "id", i_id: str = "id",
        q_vec: str = "embedding", i_vec: str = "embedding",
        partition_cols: list[str] | None = None, block_rows: int = 20_000) -> DataFrame:
    """RET-2 (+ RET-3 when ``partition_cols`` is given: candidates must share
    those values, i.e. an equality metadata pre-filter applied before
    ranking). Returns query_id, id, distance (1 - cosine), rank (1..k) by
    (distance, id)."""
    ship_package(queries.sparkSession)
    pcols = list(partition_cols or [])
    # block counts as scalar subqueries: sized from the data inside the job,
    # no eager count before planning
    qb_n, ib_n = (df.agg(n_blocks(F.count(F.lit(1)), block_rows)).scalar() for df in (queries, index))
    q = queries.select(*pcols, F.col(q_id).alias("_qid"), F.col(q_vec).alias("_qv"),
                       F.pmod(F.xxhash64(F.col(q_id)), qb_n).alias("_qb"),
                       F.explode(F.sequence(F.lit(0).cast("long"), ib_n - 1)).alias("_ib"))
    ix = index.select(*pcols, F.col(i_id).alias("_iid"), F.col(i_vec).alias("_iv"),
                      F.pmod(F.xxhash64(F.col(i_id)), ib_n).alias("_ib"),
                      F.explode(F.sequence(F.lit(0).cast("long"), qb_n - 1)).alias("_qb"))
    out_schema = T.StructType([
        T.StructField("_qid", queries.schema[q_id].dataType),
        T.StructField("_iid", index.schema[i_id].dataType),
        T.StructField("_dist", T.DoubleType())])
    keys = [*pcols, "_qb", "_ib"]
    local = (q.groupBy(*keys).cogroup(ix.groupBy(*keys))
             .applyInArrow(_local_topk(k), schema=out_schema))
    w = Window.partitionBy("_qid").orderBy(F.round("_dist", 9), F.col("_iid"))
    return (local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(F.col("_qid").alias("query_id"), F.col("_iid").alias("id"),
                    F.col("_dist").alias("distance"), "rank"))


def rounded(col: Column | str, digits: int = 6) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits) + F.lit(0.0)   # folds -0.0 into 0.0


# --------------------------------------------------------------------- RET-6
def tokens(col: Column) -> Column:
    """Distinct lower-case letter/digit runs of the whole text."""
    parts = F.split(F.lower(col), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def token_overlap(query_tokens: Column, doc_tokens: Column) -> Column:
    """Default pair score on pre-tokenised texts: shared distinct tokens;
    NULL when either side is missing (the reference's scorer fails on a
    missing document)."""
    return F.when(query_tokens.isNotNull() & doc_tokens.isNotNull(),
                  F.size(F.array_intersect(query_tokens, doc_tokens)).cast("double"))


def token_overlap_scorer(query_text: Column, doc_text: Column) -> Column:
    """Token overlap straight from texts (tokenises per pair; prefer
    tokenising each text once and calling ``token_overlap``)."""
    return token_overlap(F.when(query_text.isNotNull(), tokens(query_text)),
                         F.when(doc_text.isNotNull(), tokens(doc_text)))


def pandas_pair_scorer(model_factory: Callable[[], Callable[[list[str], list[str]], np.ndarray]],
                       cache_key: str) -> Callable[[Column, Column], Column]:
    """Plug-in path for a cross-encoder: the model is built once per Python
    worker and scores Arrow batches of (query, document) pairs; a pair with
    a missing text and the pairs of a query that the model fails on get NULL
    scores, so those queries keep recall order."""

    @F.pandas_udf(T.DoubleType())
    def _score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _MODEL_CACHE.get(cache_key)
        if model is None:
            model = _MODEL_CACHE[cache_key] = model_factory()
        for q, d in batches:
            out = pd.Series([None] * len(q), dtype="float64")
            ok = q.notna() & d.notna()
            try:
                if ok.any():
                    out[ok] = np.asarray(model(q[ok].tolist(), d[ok].tolist()), dtype=np.float64)
            except Exception:   # only the queries that fail by themselves fall back to recall order
                for rows in q[ok].groupby(q[ok]).groups.values():
                    try:
                        out[rows] = np.asarray(model(q[rows].tolist(), d[rows].tolist()), dtype=np.float64)
                    except Exception:
                        out[rows] = np.nan
            yield out

    return lambda q, d: _score(q, d)


def rerank(cands: DataFrame, score_col: str = "score", recall_rank_col: str = "rank") -> DataFrame:
    """RET-6 ordering: score descending with recall order breaking ties (a
    stable sort); when any candidate of a query has no score, that query
    keeps its recall order. Renames the recall rank to ``recall_rank`` and
    adds a new ``rank``. Groups are one query's candidates (k * recall)."""
    wq = Window.partitionBy("query_id")
    all_scored = F.min(F.col(score_col).isNotNull().cast("int")).over(wq) == 1
    scored = cands.withColumn("_ok", all_scored).withColumnRenamed(recall_rank_col, "recall_rank")
    order = Window.partitionBy("query_id").orderBy(
        F.when(F.col("_ok"), -F.col(score_col)).otherwise(F.lit(0.0)), F.col("recall_rank"))
    return scored.withColumn("rank", F.row_number().over(order)).drop("_ok")


# ------------------------------------------------------------------ RET-4/5
def shape_product_hits(hits: DataFrame, catalog: DataFrame,
                       hit_key: Column | None = None, extra: list[str] | None = None) -> DataFrame:
    """RET-4: product_id, name, category, content, price (string -> double,
    unparsable -> 0.0), selling_points[], distance. ``catalog`` holds the
    indexed documents: (id, document, metadata)."""
    extra = list(extra or [])
    cat = catalog.select(F.col("id").alias("_cid"), "document", "metadata", *extra)
    key = hit_key if hit_key is not None else F.col("id").cast("string")
    return (hits.join(by_key(cat), key == F.col("_cid"), "left")
            .select("query_id", "id", "rank", "distance",
                    F.col("metadata.product_id").alias("product_id"),
                    F.col("metadata.name").alias("name"),
                    F.col("metadata.category").alias("category"),
                    F.col("document").alias("content"),
                    F.coalesce(F.col("metadata.price").try_cast("double"), F.lit(0.0)).alias("price"),
                    split_selling_points(F.col("metadata.selling_points_str")).alias("selling_points"),
                    *extra))


def shape_script_hits(hits: DataFrame, scripts: DataFrame) -> DataFrame:
    """RET-5: id, scenario, tags, content of hits; ``scripts`` holds the indexed
    documents (id, document, metadata(scenario, tags)). Missing metadata is
    empty text."""
    s = scripts.select(F.col("id").alias("_sid"), "document", "metadata")
    return (hits.join(by_key(s), hits["id"] == F.col("_sid"), "left")
            .select("query_id", "id", "rank", "distance",
                    F.coalesce("metadata.scenario", F.lit("")).alias("scenario"),
                    F.coalesce("metadata.tags", F.lit("")).alias("tags"), F.col("document").alias("content")))


# ------------------------------------------------------------------ RET-7/8
def product_search(queries: DataFrame, index: DataFrame, catalog: DataFrame, k: int = P.SEARCH_K,
                   recall_factor: int = P.RECALL_FACTOR,
                   scorer: Callable[[Column, Column], Column] | None = None,
                   hit_key: Column | None = None) -> DataFrame:
    """RET-7 for a table of queries (id, query_text, embedding): blank query
    text -> no results; recall k * recall_factor by cosine, shape, re-rank,
    keep the first k. The default scorer tokenises each query text and each
    catalogue document once, before the candidate join."""
    live = queries.filter(~is_blank(F.col("query_text")))
    hits = knn(live.select("id", "embedding"), index, k * recall_factor)
    if scorer is None:
        cat_tok = catalog.withColumn("_dtok", tokens(F.col("document")))
        shaped = shape_product_hits(hits, cat_tok, hit_key, extra=["_dtok"])
        q = live.select(F.col("id").alias("query_id"), "query_text",
                        tokens(F.col("query_text")).alias("_qtok"))
        with_q = shaped.join(by_key(q), "query_id")
        scored = with_q.withColumn("score", token_overlap(F.col("_qtok"), F.col("_dtok")))
        scored = scored.drop("_qtok", "_dtok")
    else:
        shaped = shape_product_hits(hits, catalog, hit_key)
        with_q = shaped.join(by_key(live.select(F.col("id").alias("query_id"), "query_text")), "query_id")
        scored = with_q.withColumn("score", scorer(F.col("query_text"), F.col("content")))
    return rerank(scored).filter(F.col("rank") <= k)


def script_search(queries: DataFrame, index: DataFrame, k: int = P.SEARCH_K,
                  scenario_col: str = "scenario", all_have_scenario: bool = False) -> DataFrame:
    """RET-3 and RET-2 of RET-8: the metadata filter on scenario applies only
    when the query's scenario is non-blank; top-k by cosine; no re-rank. A
    caller whose queries all have a scenario says so and saves the search of
    the whole index."""
    if all_have_scenario:
        idx = index.select(F.col("id").alias("_iid"), F.col(scenario_col).alias("scenario"))
        hits = knn(queries.select("id", "embedding", scenario_col), index.select("id", "embedding", scenario_col), k,
                   partition_cols=[scenario_col])
        return hits.join(by_key(idx), F.col("id") == F.col("_iid")).drop("_iid")
    filtered = queries.filter(~is_blank(F.col(scenario_col)))
    unfiltered = queries.filter(is_blank(F.col(scenario_col)))
    a = knn(filtered.select("id", "embedding", scenario_col), index.select("id", "embedding", scenario_col),
            k, partition_cols=[scenario_col])
    b = knn(unfiltered.select("id", "embedding"), index.select("id", "embedding"), k)
    idx = index.select(F.col("id").alias("_iid"), F.col(scenario_col).alias("scenario"))
    return a.unionByName(b).join(by_key(idx), F.col("id") == F.col("_iid")).drop("_iid")


def search_scripts(queries: DataFrame, library: DataFrame, k: int = P.SEARCH_K, encoder: Encoder | None = None) -> DataFrame:
    """RET-8 whole, for a table of queries (id, query_text, scenario): a blank
    text finds nothing; a non-blank scenario limits the search to its scripts;
    the k nearest by cosine, shaped as RET-5 (query_id, rank, id, scenario, tags,
    content, distance). ``library``: (id, document, metadata(scenario, tags),
    embedding). Queries that bring an ``embedding`` keep it; else the text is
    embedded by the library's encoder."""
    live = queries.filter(~is_blank(F.col("query_text")))
    if "embedding" not in queries.columns:
        live = embed(live, "query_text", "embedding", encoder)
    index = library.select("id", "embedding", F.col("metadata.scenario").alias("scenario"))
    hits = script_search(live.select("id", "embedding", "scenario"), index, k)
    return shape_script_hits(hits.drop("scenario"), library)


# --------------------------------------------------------------------- RET-9
def search_text(results: DataFrame, queries: DataFrame) -> DataFrame:
    """RET-9: numbered blocks per query joined by newlines; fallback text
    when a query has no results. Groups hold at most k rows."""
    lab = P.SEARCH_TEXT_LABELS
    nl = F.lit("\n")
    none = F.lit("None")
    block = F.concat(nl, F.lit(lab[0]), F.col("rank").cast("string"), F.lit(":"),
                     nl, F.lit(lab[1]), F.coalesce("name", none),
                     nl, F.lit(lab[2]), F.coalesce("category", none),
                     nl, F.lit(lab[3]), F.coalesce(F.col("price").cast("string"), none),
                     nl, F.lit(lab[4]), F.array_join("selling_points", "; "), nl)
    per_q = (results.groupBy("query_id")
             .agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("_bs")))
    rendered = per_q.select("query_id", F.array_join(F.transform("_bs", lambda s: s["b"]), "\n")
                            .alias("text"))
    q = queries.select(F.col("id").alias("query_id"), "query_text")
    return (q.join(rendered, "query_id", "left")
            .select("query_id", F.coalesce(
                "text", F.format_string(P.SEARCH_TEXT_MISSING, F.coalesce("query_text", none)))
                .alias("text")))
