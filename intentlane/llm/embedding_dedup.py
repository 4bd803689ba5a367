"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are chosen from a bounded sample, far from each other.
A vector is described by its LIST nearest pivots in order. Vectors of cosine
0.98 see the pivots from nearly the same place, so they share most of that
list: pairs with SHARED or more pivots in common are retrieved and verified by
cosine in double precision. The recall of this against brute force is tested
(at least 0.9; what is retrieved is exact).

The inverted lists are intersected three pivots at a time: pivots form two
halves, and of five shared ones three are in one half, so a vector is posted
under the triples of its pivots in each half. A pair that meets under several
triples counts under its first common one only. Equal vectors of a label are
reduced to one with a count beforehand, and large postings are split into block
pairs, which return link counts and spanning forests, never pairs.

Vectors that are null, zero or hold null or non-finite parts, and rows with a
null label, link with nothing. Vectors of different length are never compared.
A null vec_id takes part but is nobody's component_id. Repeated rows count as
links of each other. An empty table gives an empty result; other columns are
ignored."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from intentlane.llm.common import materialise, table
from intentlane.llm.components import connected_components
from intentlane.llm.simhash import block_pairs, by_group, spanning_forest

COSINE = 0.98
PIVOTS = 128          # two halves of 64, a bit of a 64-bit mask each
LIST = 8              # nearest pivots that describe a vector
SHARED = 5            # pivots in common of a retrieved pair
SAMPLE = 4096         # vectors a length that pivots are chosen from
BLOCK = 2048          # vectors of one posting compared in one task


def usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def choose_pivots(sample: np.ndarray, count: int = PIVOTS, seed: int = 5) -> np.ndarray:
    """Unit reference points: vectors of the sample, each the farthest from
    those before; random directions fill up a small sample."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else sample
    picked: list[int] = [0] if len(x) else []
    nearest = x @ x[0] if len(x) else np.zeros(0)
    while picked and len(picked) < min(count, len(x)):
        far = int(nearest.argmin())
        if nearest[far] > 0.999:  # what is left repeats a pivot
            break
        picked.append(far)
        nearest = np.maximum(nearest, x @ x[far])
    extra = np.random.default_rng(seed).normal(size=(count - len(picked), sample.shape[1]))
    extra /= np.linalg.norm(extra, axis=1, keepdims=True)
    return np.concatenate([x[picked], extra])


def pivot_lists(x: np.ndarray, pivots: np.ndarray, length: int = LIST) -> np.ndarray:
    """The nearest pivots of each vector in order, the smaller number of equals first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length]


def _masks(lists: np.ndarray) -> np.ndarray:
    """(vectors, 2) bit masks of the listed pivots in each half."""
    out = np.zeros((len(lists), 2), np.uint64)
    for half in (0, 1):
        bits = np.where(lists // 64 == half, np.uint64(1) << (lists % 64).astype(np.uint64), np.uint64(0))
        out[:, half] = np.bitwise_or.reduce(bits, axis=1)
    return out


def _triples(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, posting): every three listed pivots of one half."""
    rows, keys = [], []
    ordered = np.sort(lists, axis=1)
    for a, b, c in combinations(range(lists.shape[1]), 3):
        same = np.flatnonzero(ordered[:, a] // 64 == ordered[:, c] // 64)
        rows.append(same)
        keys.append((ordered[same, a] << 14) + (ordered[same, b] << 7) + ordered[same, c])
    return np.concatenate(rows), np.concatenate(keys)


def _first_triple(common: np.ndarray) -> np.ndarray:
    """Posting of the first three common pivots of the first half that has three (common: (pairs, 2) masks)."""
    half = np.where(np.bitwise_count(common[:, 0]) >= 3, 0, 1)
    mask = common[np.arange(len(common)), half]
    key = np.zeros(len(common), np.int64)
    for shift in (14, 7, 0):
        low = mask & (~mask + np.uint64(1))
        key += (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) + 64 * half) << shift
        mask = mask ^ low
    return key


def _near(x: np.ndarray, nx: np.ndarray, mx: np.ndarray, y: np.ndarray, ny: np.ndarray, my: np.ndarray,
          posting: int, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share SHARED pivots, count under this posting, and have the cosine."""
    none = np.zeros(0, np.int64)
    left, right = [none], [none]
    step = max(1, (1 << 20) // max(1, len(y)))
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        shared = (np.bitwise_count(mx[part, 0, None] & my[None, :, 0]) + np.bitwise_count(mx[part, 1, None] & my[None, :, 1]))
        i, j = np.nonzero(shared >= SHARED)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        first = _first_triple(mx[i] & my[j]) == posting
        i, j = i[first], j[first]
        if len(i) * 8 > len(x[part]) * len(y):  # a dense posting: one product of the blocks
            dots = (x[part] @ y.T)[i - at, j]
        else:
            dots = np.concatenate([np.einsum("ij,ij->i", x[i[k:k + 65536]], y[j[k:k + 65536]])
                                   for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
        near = dots / (nx[i] * ny[j]) >= cosine
        left.append(i[near])
        right.append(j[near])
    return np.concatenate(left), np.concatenate(right)


def _vectors(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def vector_links(reps: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(a, b, links) from (rid, label, vector, n): rows with b are links of a
    spanning forest, rows without give the number of vectors linked with a."""
    spark = reps.sparkSession
    reps = reps.withColumn("size", F.size("vector"))
    sizes = [r["size"] for r in reps.select("size").distinct().orderBy("size").collect()]
    pivots = {}
    for size in sizes:  # vector lengths of a table: one, or a few
        sample = (reps.where(F.col("size") == size).orderBy(F.xxhash64("vector"), "rid").limit(SAMPLE)
                  .select("vector").toPandas()["vector"])
        pivots[size] = choose_pivots(np.array([np.asarray(v, np.float64) for v in sample]).reshape(-1, size))
    shared = spark.sparkContext.broadcast(pivots)  # PIVOTS vectors a length

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["size"].to_numpy()
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                x = _vectors(part["vector"], int(size))
                lists = pivot_lists(x, shared.value[int(size)])
                masks = _masks(lists)
                row, key = _triples(lists)
                for at in range(0, len(row), 50_000):
                    take = pa.array(row[at:at + 50_000])
                    yield pa.RecordBatch.from_arrays(
                        [part["label_key"].take(take), part["size"].take(take), pa.array(key[at:at + 50_000], pa.int32()),
                         part["rid"].take(take), part["n"].take(take), part["vector"].take(take),
                         pa.array(masks[:, 0].view(np.int64)).take(take), pa.array(masks[:, 1].view(np.int64)).take(take)],
                        names=["label_key", "size", "triple", "rid", "n", "vector", "m0", "m1"])

    kind = reps.schema["vector"].dataType.simpleString()
    posted = (reps.select(F.col("label").cast("string").alias("label_key"), "size", "rid", "n", "vector")
              .mapInArrow(post, f"label_key string, size int, triple int, rid bigint, n bigint, vector {kind}, m0 bigint, m1 bigint")
              .withColumn("posting", F.struct("label_key", "size", "triple")))
    posted = block_pairs(posted, "posting", "rid", block).select(
        "posting.label_key", "posting.size", "posting.triple", "left", "right", "own", "rid", "n", "vector", "m0", "m1")
    keys = ["label_key", "size", "triple", "left", "right"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, keys):
            size, triple = group["size"][0].as_py(), group["triple"][0].as_py()
            left, right = group["left"][0].as_py(), group["right"][0].as_py()
            rid, n = group["rid"].to_numpy(), group["n"].to_numpy()
            x = _vectors(group["vector"], size)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            masks = np.stack([group["m0"].to_numpy(), group["m1"].to_numpy()], 1).view(np.uint64)
            if left == right:
                i, j = _near(x, norm, masks, x, norm, masks, triple, True, cosine)
            else:
                own = group["own"].to_numpy()
                a, b = np.flatnonzero(own == left), np.flatnonzero(own == right)
                i, j = _near(x[a], norm[a], masks[a], x[b], norm[b], masks[b], triple, False, cosine)
                i, j = a[i], b[j]
            if not len(i):
                continue
            links = np.bincount(i, n[j], minlength=len(rid)) + np.bincount(j, n[i], minlength=len(rid))
            some = np.flatnonzero(links)
            member, root = spanning_forest(i, j, len(rid))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rid[some], rid[member]]), pa.int64()),
                 pa.array([None] * len(some) + rid[root].tolist(), pa.int64()),
                 pa.array(np.concatenate([links[some], np.zeros(len(member))]).astype(np.int64))], names=["a", "b", "links"])

    return (posted.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(compare, "a bigint, b bigint, links bigint"))


def embedding_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                              label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept), one row per input row."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    ok = usable(F.col("vector"), F.col("label"))
    # equal vectors of a label are one representative; its number is fixed by writing it
    reps = materialise(rows.where(ok).groupBy("label", "vector")
                       .agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"))
                       .withColumn("rid", F.monotonically_increasing_id()), "embedding-reps")
    found = materialise(vector_links(reps, cosine), "embedding-links")
    links = found.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    roots = materialise(connected_components(found.where("b is not null").select("a", "b")), "embedding-roots")
    member = (reps.join(roots, reps["rid"] == roots["node"], "left").join(links, "rid", "left")
              .select("rid", "label", "vector", "least_id", F.coalesce("root", "rid").alias("root"),
                      (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links")))
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = materialise(member.join(least, "root").select("label", "vector", "n_links", "component_id"), "embedding-classes")
    linked = rows.where(ok).join(classes, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))
