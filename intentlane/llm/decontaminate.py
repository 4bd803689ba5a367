"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become lower-cased words (ASCII punctuation
parts them). Every run of MATCH words of an item is a seed, hashed by Karp-Rabin. A
bitmap of a fixed size holds all seeds; rolled over a document it leaves the
runs that may match, which are the only places where a tile can lie. Runs are
joined with items on the exact seed hashes, and each candidate pair is tiled:
the longest match of unmarked words is marked, again and again, until none has
MATCH words. The share of the item's words under tiles is its coverage, wherever
the tiles stand, so passages in another order are caught; items with COVERAGE or
more are leaks.

Equal runs of many documents are tiled once. Items with fewer than MATCH words
match as a whole. Nulls: a null text or item has no words and never matches; a
null doc_id or item_id is carried along. Repeated rows give repeated results for
documents and one result per distinct item row. Empty tables give an empty
result; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from intentlane.llm.common import NON_ALNUM, materialise, table
from intentlane.llm.simhash import by_group

MATCH = 5          # words of a seed, and of the shortest tile
COVERAGE = 0.5     # share of an item's words under tiles
BITMAP_BITS = 27   # 16 MB, whatever the size of the benchmark
_PAGE_BITS = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word -> 64-bit hash, remembered."""
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(text: str | None, known: dict) -> np.ndarray:
    words = text.lower().encode().translate(NON_ALNUM).split() if text else []
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of k words; mixed, as the
    high bits pick the bitmap's cell."""
    if k < 1 or len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * _BASE + h[i:i + n]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


# --------------------------------------------------------------------- tiling

def greedy_tiles(item: np.ndarray, runs: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """(start in item, length) of the tiles: longest first, of equals the first
    in the item, then in the runs; marked words are used once on either side.

    Matches are looked up by Karp-Rabin hashes of ``size`` words; size starts at
    the longest possible match and is halved, down to ``least``, when no match
    of that size is left."""
    flat = np.concatenate([np.append(r, np.uint64(0)) for r in runs]) if runs else np.zeros(0, np.uint64)
    free_i = np.ones(len(item), bool)
    free_r = np.concatenate([np.append(np.ones(len(r), bool), False) for r in runs]) if runs else np.zeros(0, bool)
    tiles: list[tuple[int, int]] = []
    size = len(item)
    while size >= least:
        keys = rolling(item, size), rolling(flat, size)
        while found := _matches(item, flat, free_i, free_r, size, *keys):
            longest = max(m[0] for m in found)
            for length, i, j in sorted(m for m in found if m[0] == longest):
                if free_i[i:i + length].all() and free_r[j:j + length].all():
                    free_i[i:i + length] = False
                    free_r[j:j + length] = False
                    tiles.append((i, length))
        size = max(least, size // 2) if size > least else 0
    return tiles


def _matches(item: np.ndarray, flat: np.ndarray, free_i: np.ndarray, free_r: np.ndarray, size: int,
             key_i: np.ndarray, key_r: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal unmarked matches of ``size`` words or more: (length, place in item, place in runs)."""
    at_i, at_r = _unmarked(free_i, size), _unmarked(free_r, size)
    at_r = at_r[np.isin(key_r[at_r], key_i[at_i])]
    if not len(at_r):
        return []
    places: dict[int, list[int]] = {}
    for i, key in zip(at_i.tolist(), key_i[at_i].tolist()):
        places.setdefault(key, []).append(i)
    out = []
    for j, key in zip(at_r.tolist(), key_r[at_r].tolist()):
        for i in places.get(key, ()):
            if i and j and free_i[i - 1] and free_r[j - 1] and item[i - 1] == flat[j - 1]:
                continue  # part of a match that starts earlier
            most = min(len(item) - i, len(flat) - j)
            same = (item[i:i + most] == flat[j:j + most]) & free_i[i:i + most] & free_r[j:j + most]
            n = most if same.all() else int(same.argmin())
            if n >= size:
                out.append((n, i, j))
    return out


def _unmarked(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows without a marked word."""
    if len(free) < size:
        return np.zeros(0, np.int64)
    marked = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(marked[size:] == marked[:len(free) - size + 1])


def coverage(item: np.ndarray, runs: list[np.ndarray], match: int = MATCH) -> tuple[float, int, int]:
    """Share of the item's words under tiles, number of tiles, words of the longest."""
    least = min(match, len(item))
    tiles = greedy_tiles(item, runs, least) if least else []
    return (sum(n for _, n in tiles) / len(item) if len(item) else 0.0, len(tiles), max((n for _, n in tiles), default=0))


# ------------------------------------------------------------------------ jobs

def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _item_rows(benchmark: DataFrame, item_col: str, text_col: str, match: int) -> DataFrame:
    """(item, words array of hashes, seeds array) per distinct benchmark row with words."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    kind = rows.schema["item"].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            words = [word_hashes(t.as_py(), known) for t in batch["text"]]
            seeds = [np.unique(rolling(w, min(match, len(w)))) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch["item"], pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())),
                 pa.array([s.view(np.int64) for s in seeds], pa.list_(pa.int64()))], names=["item", "words", "seeds"])

    return materialise(rows.mapInArrow(hashes, f"item {kind}, words array<bigint>, seeds array<bigint>")
                       .where("size(words) > 0"), "decon-items")


def _bitmap(items: DataFrame) -> bytes:
    """The seeds' cells, a page of the bitmap per group; at most 2**BITMAP_BITS bits come to the driver."""
    cells = (items.select(F.explode("seeds").alias("seed"))
             .select(F.shiftrightunsigned("seed", 64 - BITMAP_BITS).cast("int").alias("cell"))
             .select(F.shiftright("cell", _PAGE_BITS).alias("page"), (F.col("cell") % (1 << _PAGE_BITS)).alias("bit")).distinct())

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["page"]):
            on = np.zeros(1 << _PAGE_BITS, bool)
            on[group["bit"].to_numpy()] = True
            yield pa.RecordBatch.from_arrays([group["page"][:1].combine_chunks(), pa.array([np.packbits(on).tobytes()])],
                                             names=["page", "bits"])

    out = bytearray(1 << (BITMAP_BITS - 3))
    size = 1 << (_PAGE_BITS - 3)
    made = cells.repartition("page").sortWithinPartitions("page").mapInArrow(pages, "page int, bits binary")
    for row in made.collect():
        out[row["page"] * size:(row["page"] + 1) * size] = row["bits"]
    return bytes(out)


def matching_runs(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, match: int) -> DataFrame:
    """(id, th, key, runs): documents with words that may match an item; runs are
    arrays of word hashes, key a digest of them, th the hash of the text."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_bitmap(items))
    # windows of MATCH words, and of the lengths of shorter items
    lengths = sorted(r["n"] for r in items.select(F.least(F.size("words"), F.lit(match)).alias("n")).distinct().collect())
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = _Hashes(), np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            at, runs, keys = [], [], []
            for n, text in enumerate(batch["text"]):
                h = word_hashes(text.as_py(), known)
                inside = np.zeros(len(h) + 1, np.int64)
                for k in lengths:
                    cell = rolling(h, k) >> np.uint64(64 - BITMAP_BITS)
                    hit = np.flatnonzero(bits[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8)) & 1)
                    np.add.at(inside, hit, 1)
                    np.add.at(inside, hit + k, -1)
                on = np.cumsum(inside)[:-1] > 0
                if on.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
                    here = [h[a:b] for a, b in zip(edge[::2], edge[1::2])]
                    at.append(n)
                    runs.append([r.view(np.int64) for r in here])
                    keys.append(hashlib.blake2b(b"|".join(r.tobytes() for r in here), digest_size=16).digest())
            if at:
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].take(take), batch["th"].take(take), pa.array(keys, pa.binary()),
                     pa.array(runs, pa.list_(pa.list_(pa.int64())))], names=["id", "th", "key", "runs"])

    return materialise(rows.mapInArrow(scan, f"id {kind}, th bigint, key binary, runs array<array<bigint>>"), "decon-runs")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", match: int = MATCH, least_coverage: float = COVERAGE) -> DataFrame:
    """(id, item, coverage, tiles, longest_tile, th): items whose words are
    covered by tiles of a document to at least ``least_coverage``; th is
    xxhash64 of the document's text."""
    items = _item_rows(benchmark, item_col, item_text_col, match)
    found = matching_runs(docs, items, id_col, text_col, match)
    distinct = found.groupBy("key").agg(F.first("runs").alias("runs"))  # equal key, equal runs
    runs = materialise(distinct, "decon-distinct")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, row in zip(batch["key"], batch["runs"]):
                got = [rolling(np.array(r, np.int64).view(np.uint64), k) for r in row.as_py() for k in range(1, match + 1)]
                got = np.unique(np.concatenate(got)) if got else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(got), pa.binary()), _signed(got)],
                                                 names=["key", "seed"])

    items = items.withColumn("row", F.xxhash64("item", "words"))
    pairs = (runs.mapInArrow(seeds, "key binary, seed bigint")
             .join(items.select("row", F.explode("seeds").alias("seed")), "seed")
             .select("key", "row").distinct())
    joined = (materialise(pairs, "decon-pairs").join(runs, "key")
              .join(items.select("row", "item", "words"), "row").select("key", "item", "words", "runs"))
    kind = items.schema["item"].dataType.simpleString()

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [coverage(np.array(w.as_py(), np.int64).view(np.uint64),
                            [np.array(r, np.int64).view(np.uint64) for r in rs.as_py()], match)
                   for w, rs in zip(batch["words"], batch["runs"])]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["item"], pa.array([c for c, _, _ in out], pa.float64()),
                 pa.array([t for _, t, _ in out], pa.int32()), pa.array([x for _, _, x in out], pa.int32())],
                names=["key", "item", "coverage", "tiles", "longest_tile"])

    tiled = materialise(joined.mapInArrow(tile, f"key binary, item {kind}, coverage double, tiles int, longest_tile int")
                        .where(F.col("coverage") >= F.lit(least_coverage)), "decon-tiled")
    return found.select("id", "th", "key").join(tiled, "key").select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "coverage", "tiles", "longest_tile", "th")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns."""
    found = materialise(leaks(docs, benchmark, id_col, text_col)
                        .select(F.col(id_col).alias("_id"), F.col("th").alias("_th")).distinct(), "decon-leaks")
    return docs.join(found, docs[id_col].eqNullSafe(found["_id"]) & (F.xxhash64(docs[text_col]) == found["_th"]), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")
