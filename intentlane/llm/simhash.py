"""SimHash near-duplicates: byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints at most
``max_bits`` = 3 bits apart differ in at most three of them, so they share at
least five. The index posts every distinct fingerprint under its positional
bytes, intersected three positions at a time: of five positions out of eight, at
least three lie in one half (positions 0-3 or 4-7), so the eight 24-bit postings
(four triples a half) bring every such pair together, and few others. Inside a
posting the shared positional bytes of each pair are tallied, pairs with five or
more are kept and verified bit by bit.

Equal fingerprints are reduced to one before indexing, so groups of copies cost
nothing; large postings are split into pairs of blocks, and each block pair
returns a spanning forest of its links, never all pairs, which is what
connected components need.

Nulls: a null text has no words, so fingerprint zero, linked like any other. A
null doc_id gets a fingerprint and is no candidate for component_id (null where
a component has no other). Repeated rows share a fingerprint. An empty table
gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from intentlane.llm.common import materialise, table, text_slices
from intentlane.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
BLOCK = 2048          # fingerprints of one posting compared in one task
_STEP = 1 << 18       # shingles counted at once
#: bits of each byte value, most significant first
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.float64)
#: three positions at a time, within each half of the fingerprint
TRIPLES = [tuple(p for p in range(h, h + 4) if p != skip) for h in (0, 4) for skip in range(h, h + 4)]


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(text: str | None, k: int = SHINGLE_WORDS, seed: int = SEED) -> bytes:
    """XXH64 digests (8 bytes each) of the k-word shingles of the lower-cased text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return b""
    digest = xxhash.xxh64_digest
    line = b" ".join(words)
    if len(words) <= k:
        return digest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-k].tolist()]
    return b"".join([digest(line[a:b], seed) for a, b in zip(starts, (ends[k - 1:] - 1).tolist())])


def majority_bits(digests: list[bytes]) -> np.ndarray:
    """One unsigned fingerprint per digest list: a bit is 1 if set in over half of the hashes."""
    sizes = np.array([len(d) // 8 for d in digests], np.int64)
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    out = np.zeros((len(digests), 8), np.uint8)
    doc = np.repeat(np.arange(len(digests)), sizes) * 256
    for byte in range(8):
        seen = np.bincount(doc + raw[:, byte], minlength=256 * len(digests)).reshape(-1, 256)
        out[:, byte] = np.packbits(2 * (seen @ _BITS) > sizes[:, None], axis=1)[:, 0]
    return out.view(">u8")[:, 0].astype(np.uint64)


def fingerprints(texts: Iterator[str | None], k: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    done, held, n = [], [], 0
    for text in texts:
        held.append(shingle_hashes(text, k, seed))
        n += len(held[-1]) // 8
        if n >= _STEP or len(held) >= 512:
            done.append(majority_bits(held))
            held, n = [], 0
    if held:
        done.append(majority_bits(held))
    return np.concatenate(done) if done else np.zeros(0, np.uint64)


def fingerprint(text: Column, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    """The fingerprint of a text column, as a bigint with the same 64 bits."""
    @F.arrow_udf("bigint")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [fingerprints(part.to_pylist(), shingle_words, seed) for part in text_slices(texts)]
            yield pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))
    return udf(text)


# --------------------------------------------------------------- inverted index

def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def postings(fps: DataFrame) -> DataFrame:
    """(posting, fp): eight postings per fingerprint."""
    keys = []
    for n, (a, b, c) in enumerate(TRIPLES):
        fp = F.col("fp")
        keys.append(F.shiftleft(F.lit(n).cast("bigint"), 24)
                    + F.shiftleft(_byte(fp, a), 16) + F.shiftleft(_byte(fp, b), 8) + _byte(fp, c))
    return fps.select(F.explode(F.array(*keys)).alias("posting"), "fp")


def block_pairs(rows: DataFrame, key: str, item: str, block: int) -> DataFrame:
    """Rows of keys that hold two items or more, each copied to the block pairs
    (left, right) of its key that it takes part in; ``own`` is its block. A key
    of up to ``block`` items has the one pair (0, 0)."""
    sizes = materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "posting-sizes")
    blocks = F.ceil(F.col("held") / F.lit(block)).cast("int")
    held = (rows.join(sizes, key).withColumn("blocks", blocks)
            .withColumn("own", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")))
    return (held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other"))
            .drop("other", "blocks", "held"))


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by ``keys``, one table each;
    only the last, unfinished group is held between batches."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def spanning_forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, component minimum) that join what the links a-b join, among 0..n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[label]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def linked_pairs(x: np.ndarray, y: np.ndarray, same: bool, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of x and y within ``max_bits`` bits; of one block (same), each pair once.

    Count filter first: positional bytes in common, at least 8 - max_bits."""
    xb, yb = x.view(np.uint8).reshape(-1, 8), y.view(np.uint8).reshape(-1, 8)
    step = max(1, (1 << 20) // max(1, len(y)))
    none = np.zeros(0, np.int64)
    left, right = [none], [none]
    for at in range(0, len(x), step):
        shared = np.zeros((len(x[at:at + step]), len(y)), np.int8)
        for p in range(8):
            shared += xb[at:at + step, p, None] == yb[None, :, p]
        i, j = np.nonzero(shared >= 8 - max_bits)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        near = np.bitwise_count(x[i] ^ y[j]) <= max_bits
        left.append(i[near])
        right.append(j[near])
    return np.concatenate(left), np.concatenate(right)


_LINKS = "a bigint, b bigint"


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints of ``fps`` (distinct)
    that chains of at most ``max_bits`` differing bits connect."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the three-position postings guarantee up to 3 differing bits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["posting", "left", "right"]):
            fp = group["fp"].to_numpy().view(np.uint64)
            left, right = group["left"][0].as_py(), group["right"][0].as_py()
            if left == right:
                i, j = linked_pairs(fp, fp, True, max_bits)
            else:
                own = group["own"].to_numpy()
                fp = np.concatenate([fp[own == left], fp[own == right]])
                n = int((own == left).sum())
                i, j = linked_pairs(fp[:n], fp[n:], False, max_bits)
                j = j + n
            if len(i):
                a, b = spanning_forest(i, j, len(fp))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["a", "b"])

    pairs = block_pairs(postings(fps), "posting", "fp", block)
    return (pairs.repartition("posting", "left", "right").sortWithinPartitions("posting", "left", "right")
            .mapInArrow(compare, _LINKS))


def simhash_components(rows: DataFrame, id_col: str = "doc_id", fp_col: str = "fp",
                       max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) per distinct fingerprint: its component, and the smallest id in it."""
    nodes = materialise(rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least_id")), "simhash-fps")
    roots = materialise(connected_components(fingerprint_links(nodes.select("fp"), max_bits)), "simhash-roots")
    member = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return materialise(member.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "simhash-components")


def simhash_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint as 16 hexadecimal digits, component_id), one row per input row."""
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"),
                                   fingerprint(F.col(text_col), shingle_words).alias("fp")), "simhash-rows")
    components = simhash_components(rows, "doc_id", "fp", max_bits)
    return rows.join(components.drop("root"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with the smallest id (nulls last, then the text's
    hash) of each component, all columns; of rows equal in id and text, the one
    that is smallest by all its columns (as JSON)."""
    text_hash = F.xxhash64(F.col(text_col))
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), text_hash.alias("th"),
                                   fingerprint(F.col(text_col), shingle_words).alias("fp")), "simhash-rows")
    components = simhash_components(rows, "doc_id", "fp", max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    by_fp = materialise(rows.groupBy("fp").agg(first.alias("first")), "simhash-first")
    keep = materialise(by_fp.join(components, "fp").groupBy("root").agg(F.min("first").alias("first"))
                       .select(F.col("first.doc_id").alias("_id"), F.col("first.th").alias("_th")), "simhash-keep")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), text_hash.alias("th"))
    kept = marked.join(keep, marked["doc_id"].eqNullSafe(keep["_id"]) & (marked["th"] == keep["_th"]), "left_semi")
    return (kept.groupBy("doc_id", "th").agg(F.min_by("row", F.to_json("row")).alias("row"))
            .select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"))
