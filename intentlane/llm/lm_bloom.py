"""Language-model scoring with a log-frequency Bloom filter.

Word and word-pair counts of all training documents are quantised on a
logarithmic scale that starts at one occurrence, whatever the corpus size. An
n-gram of level l is stored under the keys (n-gram, 1) .. (n-gram, l), so its
level is read back by probing the filter with growing numbers until a probe
fails; a codebook turns levels into mean counts.

The filters hold all n-grams of the corpus and grow with it, so no worker holds
one whole: they are cut by the n-gram's hash into parts of 512 KB. The texts are
numbered once, in blocks of about _TEXTS bytes. A block's distinct pairs go to
their parts with their training counts, by one shuffle: a part's task sums the
counts, sets the part's bits and probes them for the same pairs, whose levels
come back to the block by another. Each token's probability depends
on three levels alone (context, word and pair), so a document is kept as the
counts of its level triples: pair counts are interpolated with word counts, and
the weights fitted on all training documents, by the context's frequency.

The exact base score needs exact word counts. Words with a share of HEAD_SHARE
or more (at most 1 / HEAD_SHARE) go to the workers; a block's other words go to
the parts of the counts table, once each. A part's task sets the bits of its
part of the word filter and probes them, and a word's count and level come back
to the block together. A block is kept as its token numbers, the numbers of its
head words and the text of its other words; hashes are made anew where needed.

Nulls: a null text has the end token only; a null doc_id is a training document.
Rows that repeat id and text are scored each. Without training documents all
counts are zero. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import gc
import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from intentlane.functions.memory import give_back
from intentlane.llm.common import SMALL_ROW_GROUPS, is_rest, materialise, small_batches, table
from intentlane.llm.simhash import by_group

STEP = 1.5             # ratio of neighbouring levels
BITS_PER_KEY = 12
PROBES = 6
HEAD_SHARE = 2e-6      # words whose exact counts all workers hold
END = b""              # the end token; no word is empty
_SHARD_BITS = 22       # bits of one part of a filter, 512 KB
_TEXTS = 1 << 21       # bytes of text scored at once
_LEVELS = 128          # more than the scale has: STEP ** 127 occurrences
_CODES = _LEVELS ** 3
_ASKED = 1_000_000     # training tokens outside the head for each part of the counts table
_DOCS = 500            # documents whose level triples are read at once
_SPARE_BITS = 12       # of a pair's hash beyond those that number the training pairs
_GRID = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])


# --------------------------------------------------------------------- hashing

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unused_bits(total: int) -> int:
    """Bits of a pair's hash that are not needed: a pair shares its hash with one
    of the training pairs (at most ``total``) with odds of 1 to 2 ** _SPARE_BITS,
    far more seldom than a probe of the filter is false."""
    return max(0, 64 - max(32, total.bit_length() + _SPARE_BITS))


def pair_hashes(left: np.ndarray, right: np.ndarray, unused: int = 0) -> np.ndarray:
    return _mix(left * np.uint64(0x9E3779B97F4A7C15) + right) >> np.uint64(unused) << np.uint64(unused)


_CODEC = pa.Codec("zstd", 1)


def packed(x: np.ndarray) -> bytes:
    """The numbers byte by byte (all first bytes, all second ones ...), compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    raw = _CODEC.decompress(blob[8:], n * size, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def packed_words(words: list[bytes]) -> bytes:
    """The words, which hold no line break, one a line, compressed."""
    raw = b"\n".join(words)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpacked_words(blob: bytes) -> list[bytes]:
    """At least one word."""
    size = int.from_bytes(blob[:8], "little")
    return (_CODEC.decompress(blob[8:], size, asbytes=True) if size else b"").split(b"\n")


def packed_hashes(h: np.ndarray, unused: int = 0) -> bytes:
    """Hashes in rising order, as differences; their last ``unused`` bits are zero."""
    return packed(np.diff(h >> np.uint64(unused), prepend=np.uint64(0)))


def unpacked_hashes(blob: bytes, unused: int = 0) -> np.ndarray:
    return np.cumsum(unpacked(blob, np.uint64), dtype=np.uint64) << np.uint64(unused)


def packed_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 in rising order, as differences."""
    return packed(np.diff(x, prepend=0).astype(np.uint32))


def unpacked_numbers(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, np.uint32), dtype=np.int64)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def tokens(text: str | None) -> list[bytes]:
    words = text.encode().lower().split() if text else []
    words.append(END)
    return words


@dataclass
class Block:
    """The tokens of some texts: numbers into ``words``, texts one after another."""
    words: list[bytes]
    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(texts: list[str | None]) -> "Block":
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids, sizes = [], []
        for text in texts:
            row = tokens(text)
            ids.append(np.fromiter(map(number.__getitem__, row), np.int64, len(row)))
            sizes.append(len(row))
        sizes_ = np.array(sizes, np.int64)
        return Block(list(number), np.concatenate(ids) if ids else np.zeros(0, np.int64),
                     np.cumsum(sizes_) - sizes_, sizes_)

    def contexts(self) -> np.ndarray:
        """Number of the token before each token; of a text's first token, of the end token."""
        out = np.empty_like(self.ids)
        out[1:] = self.ids[:-1]
        out[self.starts] = self.words.index(END) if len(self.words) else 0
        return out


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of the batches, of about _TEXTS bytes of text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy().astype(np.int64) + 50)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            n = max(at + 1, int(np.searchsorted(ends, before + _TEXTS, "right")))
            part = batch.slice(at, n - at)
            yield part, Block.of(part[column].to_pylist())
            at = n
        give_back()


# ---------------------------------------------------------------------- filter

@dataclass
class Filter:
    """Levels of n-grams, and the mean count of each level (index 0 unused)."""
    bits: np.ndarray
    shards: int
    codebook: np.ndarray

    def levels(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        on = np.arange(len(h))
        for level in range(1, len(self.codebook)):
            on = on[self._holds(key_of(h[on], level), shard_of(h[on], self.shards))]
            if not len(on):
                break
            out[on] = level
        return out

    def _holds(self, key: np.ndarray, shard: np.ndarray) -> np.ndarray:
        if not self.shards:
            return np.zeros(len(key), bool)
        ok = np.arange(len(key))
        for i in range(PROBES):
            at = places(key[ok], i) + (shard[ok] << _SHARD_BITS)
            ok = ok[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
        out = np.zeros(len(key), bool)
        out[ok] = True
        return out


def key_of(h: np.ndarray, level: int | np.ndarray) -> np.ndarray:
    return _mix(h + np.asarray(level, np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The part of the filter that holds all levels of an n-gram."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def shard_column(shards: int) -> Column:
    """``shard_of`` of the column ``h``."""
    return F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * F.lit(shards).cast("bigint"), 32).cast("int")


def places(key: np.ndarray, probe: int) -> np.ndarray:
    low, high = key & np.uint64(0xFFFFFF), (key >> np.uint64(24)) | np.uint64(1)
    return ((low + np.uint64(probe) * high) & np.uint64((1 << _SHARD_BITS) - 1)).astype(np.int64)


def codebook_of(stats: list) -> np.ndarray:
    """Mean count of each level, from (level, n, c)."""
    codebook = np.zeros(max((r["level"] for r in stats), default=0) + 1)
    for r in stats:
        codebook[r["level"]] = r["c"] / r["n"]
    for level in range(1, len(codebook)):  # a level nobody has, reached by a false probe
        codebook[level] = codebook[level] or codebook[level - 1] * STEP
    return codebook


def bits_of(h: np.ndarray, top: np.ndarray) -> bytes:
    """The part of a filter with these n-grams of these levels."""
    on = np.zeros(1 << _SHARD_BITS, bool)
    for level in range(1, int(top.max()) + 1):
        key = key_of(h[top >= level], level)
        for i in range(PROBES):
            on[places(key, i)] = True
    return np.packbits(on, bitorder="little").tobytes()


def filter_size(grams: DataFrame) -> tuple[int, np.ndarray]:
    """The number of parts and the codebook, from (level, c): a part has about 2**_SHARD_BITS / BITS_PER_KEY keys."""
    stats = grams.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()  # a few dozen
    keys = sum(r["n"] * r["level"] for r in stats)
    return math.ceil(keys * BITS_PER_KEY / (1 << _SHARD_BITS)), codebook_of(stats)


def filter_parts(grams: DataFrame) -> tuple[DataFrame, int, np.ndarray]:
    """(shard, bits), the number of parts and the codebook, from (h, level, c);
    the bits are set part by part."""
    shards, codebook = filter_size(grams)

    def to_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["shard"]):
            h, top = group["h"].to_numpy().view(np.uint64), group["level"].to_numpy()
            yield pa.RecordBatch.from_arrays([group["shard"][:1].combine_chunks(), pa.array([bits_of(h, top)])], names=["shard", "bits"])
        give_back()

    # in the JVM: the task's worker for the hashes is the only one
    made = (grams.select(shard_column(shards).alias("shard"), "h", F.col("level").cast("tinyint"))
            .repartition("shard").sortWithinPartitions("shard").mapInArrow(to_bits, "shard int, bits binary"))
    return made, shards, codebook


def build_filter(grams: DataFrame) -> Filter:
    """A whole filter in one place, for few n-grams."""
    parts, shards, codebook = filter_parts(grams)
    size = 1 << (_SHARD_BITS - 3)
    bits = np.zeros(shards * size, np.uint8)
    for row in parts.toLocalIterator():
        bits[row["shard"] * size:(row["shard"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return Filter(bits, shards, codebook)


def with_levels(counted: DataFrame, unit: float) -> DataFrame:
    """n-grams that reach the scale, with their level on it."""
    level = F.floor(F.log(F.col("c") / F.lit(unit)) / F.lit(math.log(STEP)) + F.lit(1e-9)) + 1
    return counted.where(F.col("c") >= F.lit(unit)).withColumn("level", level.cast("int"))


def levels_of(counts: np.ndarray) -> np.ndarray:
    """The levels of exact counts on the scale from one; 0 for no occurrence."""
    return np.where(counts > 0, np.floor(np.log(np.maximum(counts, 1)) / math.log(STEP) + 1e-9) + 1, 0).astype(np.int64)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Materialised in small row groups; the shuffles behind it go once the driver has
    collected what refers to them."""
    with small_batches(df.sparkSession):
        out = materialise(df, name, **SMALL_ROW_GROUPS)
    del df
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


# -------------------------------------------------------------------- counting

def word_counts(texts: DataFrame) -> DataFrame:
    """(w, c) of all tokens, summed per task before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, counts = list(seen), list(seen.values())
            seen.clear()
            give_back()
            for at in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at:at + 100_000], pa.binary()),
                                                  pa.array(counts[at:at + 100_000], pa.int64())], names=["w", "c"])

        for batch in batches:
            for text in batch["text"]:
                seen.update(tokens(text.as_py()))
                if len(seen) > 200_000:
                    yield from out()
        yield from out()
        give_back()

    return texts.mapInArrow(count, "w binary, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


def hashed_words(counted: DataFrame) -> DataFrame:
    """Adds ``h``, the hash that ``hashes_of`` gives a word."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashes_of(batch["w"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["w"], pa.array(h.view(np.int64)), batch["c"]], names=["w", "h", "c"])
        give_back()
    return counted.select("w", "c").mapInArrow(add, "w binary, h bigint, c bigint")


_BLOCK = ("block bigint, id array<{0}>, train array<boolean>, sizes binary, ids binary, "
          "end_id bigint, known binary, tail binary, n_head binary, base binary")


def number_texts(rows: DataFrame, head: dict[bytes, int], divisor: float) -> DataFrame:
    """A row for each block of (id, train, text): its documents, its tokens as
    numbers, the words they number (``known``: those of the head, by their place
    in it; after them ``tail``, the others) and the documents' sums over the head."""
    kind = rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(head)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(shared.value)}
        counts = np.fromiter(shared.value.values(), np.float64, len(place))
        for batch, block in blocks(batches):
            at = np.fromiter((place.get(w, -1) for w in block.words), np.int64, len(block.words))
            known, tail = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            known = known[np.argsort(at[known])]
            order = np.concatenate([known, tail])
            number = np.empty_like(order)
            number[order] = np.arange(len(order))
            ids = number[block.ids]
            doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
            of_head = ids < len(known)
            base = np.log10((counts[at[known]] + 0.1) / divisor)
            base = np.bincount(doc[of_head], base[ids[of_head]], minlength=len(block.sizes))
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch[c]) for c in ("id", "train")]
            blobs = [block.sizes.tobytes(), packed(ids.astype(np.uint32))]
            more = [packed_numbers(at[known]), packed_words([block.words[i] for i in tail]) if len(tail) else b"",
                    np.bincount(doc[of_head], minlength=len(block.sizes)).tobytes(), base.tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65], pa.int64()), *lists, *(pa.array([x], pa.binary()) for x in blobs),
                 pa.array([number[block.words.index(END)]], pa.int64()), *(pa.array([x], pa.binary()) for x in more)],
                names=["block", "id", "train", "sizes", "ids", "end_id", "known", "tail", "n_head", "base"])

    return rows.mapInArrow(number, _BLOCK.format(kind))


def tail_of(blob: bytes) -> list[bytes]:
    """The words of a block's ``tail``."""
    return unpacked_words(blob) if blob else []


@dataclass
class Numbered:
    """The numbers of a stored block."""
    ids: np.ndarray
    sizes: np.ndarray
    end: int
    known: np.ndarray      # places in the head of the first words
    hashes: np.ndarray

    @staticmethod
    def of(table_: pa.RecordBatch | pa.Table, i: int, head: np.ndarray) -> "Numbered":
        """``head``: the hashes of the head's words."""
        known = unpacked_numbers(table_["known"][i].as_py())
        return Numbered(unpacked(table_["ids"][i].as_py(), np.uint32).astype(np.int64), np.frombuffer(table_["sizes"][i].as_py(), np.int64),
                        table_["end_id"][i].as_py(), known, np.concatenate([head[known], hashes_of(tail_of(table_["tail"][i].as_py()))]))

    def contexts(self) -> np.ndarray:
        out = np.empty_like(self.ids)
        out[1:] = self.ids[:-1]
        out[np.cumsum(self.sizes) - self.sizes] = self.end
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs (context and word), and the pair of each token."""
        kinds, which = np.unique(self.contexts() * len(self.hashes) + self.ids, return_inverse=True)
        return kinds // len(self.hashes), kinds % len(self.hashes), which


# ---------------------------------------------------------------------- levels

def _by_shard(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, and so by part; the parts met; where each begins in that order."""
    order = np.argsort(h, kind="stable")
    shard = shard_of(h[order], shards)
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(h) else np.zeros(0, np.int64)
    return order, shard[first].astype(np.int32), first


def word_totals(blocks_: DataFrame, counted: DataFrame, rare: int, parts: int = 1, codebook: np.ndarray = np.zeros(1)) -> DataFrame:
    """(block, shard, counts, levels): the exact training counts of each block's
    tail words, and their levels as read in the word filter (of at least ``parts``
    parts and this codebook).

    The words themselves go to the part of the counts table that has their hash,
    so that two words of one hash keep their own counts. A part is asked for a
    word once by each block that has it, for _ASKED training tokens at most (and
    those of the other texts); ``rare`` is the number of the tail's training tokens."""
    shards = max(1, parts, math.ceil(rare / _ASKED))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = tail_of(batch["tail"][i].as_py())
                if not words:
                    continue
                order, shard, first = _by_shard(hashes_of(words), shards)
                words = [words[i] for i in order.tolist()]
                ends = [*first[1:].tolist(), len(words)]
                asked = [packed_words(words[a:b]) for a, b in zip(first.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), batch["block"][i].as_py())), pa.array(shard),
                                                  pa.array(asked, pa.binary())], names=["block", "shard", "asked"])
        give_back()

    def answer(asked: pa.Table, part: pa.Table) -> pa.Table:
        give_back()
        all_ = [unpacked_words(x) for x in asked["asked"].to_pylist()]
        words = [w for x in all_ for w in x]
        h, c = part["h"].to_numpy().view(np.uint64), part["c"].to_numpy().astype(np.int64)
        bits = np.frombuffer(bits_of(h, levels_of(c)) if words and len(h) else bytes(1 << (_SHARD_BITS - 3)), np.uint8)
        filter_ = Filter(bits, 1, codebook)
        at = pc.fill_null(pc.index_in(pa.array(words, pa.binary()), value_set=part["w"].combine_chunks()), len(h)).to_numpy(zero_copy_only=False)
        count = np.append(c, 0)[at]                                   # the last for a word without a count
        level = np.append(filter_.levels(h), 0)[at]
        new = np.flatnonzero(at == len(h))
        level[new] = filter_.levels(hashes_of([words[i] for i in new.tolist()]))
        cuts = np.cumsum([len(x) for x in all_])[:-1]
        found = [[packed(y) for y in np.split(x, cuts)] if all_ else [] for x in (count, level.astype(np.int8))]
        return pa.table({"block": asked["block"].cast(pa.int64()), "shard": asked["shard"].cast(pa.int32()),
                         "counts": pa.array(found[0], pa.binary()), "levels": pa.array(found[1], pa.binary())})

    asked = blocks_.select("block", "tail").mapInArrow(ask, "block bigint, shard int, asked binary")
    table_ = hashed_words(counted).select(shard_column(shards).alias("shard"), "w", "h", "c")
    return (asked.groupBy("shard").cogroup(table_.groupBy("shard"))
            .applyInArrow(answer, "block bigint, shard int, counts binary, levels binary"))


def pair_levels(blocks_: DataFrame, total: int, head: Broadcast) -> tuple[DataFrame, np.ndarray]:
    """(block, shard, levels) of each block's pairs, and the codebook. ``head``:
    hashes and levels of the head's words.

    A block's distinct pairs go to their part with the number of their training
    occurrences. A part is filled by at most 2**_SHARD_BITS / BITS_PER_KEY
    training tokens' keys, however large the corpus, and asked for as many pairs
    at most (and those of the other texts)."""
    shards = max(1, math.ceil(total * BITS_PER_KEY / (1 << _SHARD_BITS)))
    unused = unused_bits(total)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Numbered.of(batch, i, head.value[0])
                a, b, which = block.pairs()
                if not len(a):
                    continue
                on = np.repeat(np.array(batch["train"][i].as_py(), bool), block.sizes)
                n = np.bincount(which[on], minlength=len(a)).astype(np.uint32)
                h = pair_hashes(block.hashes[a], block.hashes[b], unused)
                order, shard, first = _by_shard(h, shards)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), batch["block"][i].as_py())), pa.array(shard),
                     pa.array([packed_hashes(x, unused) for x in np.split(h[order], first[1:])], pa.binary()),
                     pa.array([packed(x) for x in np.split(n[order], first[1:])], pa.binary())], names=["block", "shard", "asked", "n"])

    def answer(asked: pa.Table) -> pa.Table:
        give_back()
        all_ = [unpacked_hashes(x, unused) for x in asked["asked"].to_pylist()]
        h, which = np.unique(np.concatenate(all_), return_inverse=True)
        c = np.bincount(which, np.concatenate([unpacked(x, np.uint32) for x in asked["n"].to_pylist()]), minlength=len(h)).astype(np.int64)
        top = levels_of(c)
        bits = np.frombuffer(bits_of(h[top > 0], top[top > 0]) if c.any() else bytes(1 << (_SHARD_BITS - 3)), np.uint8)
        level = Filter(bits, 1, np.zeros(_LEVELS)).levels(h).astype(np.int8)[which]
        found = [packed(x) for x in np.split(level, np.cumsum([len(x) for x in all_])[:-1])]
        some = top > 0
        stats = [np.bincount(top[some]).tolist(), np.bincount(top[some], c[some]).astype(np.int64).tolist()]
        once = [[x, *[None] * (asked.num_rows - 1)] for x in stats]     # with the part's first answer
        return pa.table({"block": asked["block"].cast(pa.int64()), "shard": asked["shard"].cast(pa.int32()), "levels": pa.array(found, pa.binary()),
                         "n": pa.array(once[0], pa.list_(pa.int64())), "c": pa.array(once[1], pa.list_(pa.int64()))})

    asked = (blocks_.select("block", "train", "sizes", "ids", "end_id", "known", "tail")
             .mapInArrow(ask, "block bigint, shard int, asked binary, n binary"))
    answers = stored(asked.groupBy("shard").applyInArrow(
        answer, "block bigint, shard int, levels binary, n array<bigint>, c array<bigint>"), "lm-pairs")
    stats = (answers.where("n is not null").select(F.posexplode(F.arrays_zip("n", "c")).alias("level", "x")).groupBy("level")
             .agg(F.sum("x.n").alias("n"), F.sum("x.c").alias("c")).where("n > 0").collect())  # a few dozen
    return answers.select("block", "shard", "levels"), codebook_of(stats)


def level_triples(blocks_: DataFrame, words: DataFrame, pairs: DataFrame, total: int, divisor: float, head: Broadcast) -> DataFrame:
    """(id, train, n_tokens, n_known, base, codes, times): for each document, its
    exact sums and how often each triple of levels (context, word, pair; see
    ``code_of``) occurs."""
    kind = blocks_.schema["id"].dataType.elementType.simpleString()
    unused = unused_bits(total)
    answers = words.select("block", "shard", "levels", "counts")     # counts are null where an answer is about pairs
    answers = answers.unionAll(pairs.select("block", "shard", "levels", F.lit(None).cast("binary")))

    def join(part: pa.Table, found: pa.Table) -> pa.Table:
        give_back()
        block = Numbered.of(part, 0, head.value[0])
        a, b, which = block.pairs()
        found = found.sort_by("shard")
        of_words = pc.is_valid(found["counts"])

        def answered(column: str, about: pa.ChunkedArray, h: np.ndarray, kind: type) -> np.ndarray:
            """What the parts found for the hashes; none without training texts."""
            out = np.zeros(len(h), np.int64)
            got = [unpacked(x, kind) for x in found[column].filter(about).to_pylist()]
            if got:    # in the order of the hashes, part after part
                out[np.argsort(h, kind="stable")] = np.concatenate(got)
            return out

        tail = np.arange(len(block.hashes)) >= len(block.known)
        word, count = np.zeros(len(tail), np.int64), np.zeros(len(tail), np.int64)
        word[~tail] = head.value[1][block.known]
        word[tail] = answered("levels", of_words, block.hashes[tail], np.int8)
        count[tail] = answered("counts", of_words, block.hashes[tail], np.int64)
        pair = answered("levels", pc.invert(of_words), pair_hashes(block.hashes[a], block.hashes[b], unused), np.int8)
        # a pair with a word that never occurs was reached by a false probe
        code = code_of(word[a], word[b], np.where((word[a] > 0) & (word[b] > 0), pair, 0))
        doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
        each, times = np.unique(doc * _CODES + code[which], return_counts=True)
        cuts = np.searchsorted(each // _CODES, np.arange(1, len(block.sizes)))
        lists = [part[c].combine_chunks().flatten() for c in ("id", "train")]
        on = tail[block.ids]
        mine, c = doc[on], count[block.ids[on]]
        sums = [block.sizes, np.frombuffer(part["n_head"][0].as_py(), np.int64) + np.bincount(mine[c > 0], minlength=len(block.sizes)),
                np.frombuffer(part["base"][0].as_py(), np.float64)
                + np.bincount(mine, np.log10((c + 0.1) / divisor), minlength=len(block.sizes))]
        codes = [packed(np.diff(x, prepend=np.int32(0))) for x in np.split((each % _CODES).astype(np.int32), cuts)]
        return pa.table([*lists, *map(pa.array, sums), pa.array(codes, pa.binary()), pa.array([packed(x) for x in np.split(times.astype(np.int32), cuts)], pa.binary())],
                        names=["id", "train", "n_tokens", "n_known", "base", "codes", "times"])

    return (blocks_.select("block", "id", "train", "sizes", "ids", "end_id", "known", "tail", "n_head", "base")
            .groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(join, f"id {kind}, train boolean, n_tokens bigint, n_known bigint, base double, codes binary, times binary"))


def _codes(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes of each document, and all their numbers."""
    codes = [np.cumsum(unpacked(x, np.int32), dtype=np.int64) for x in batch["codes"].to_pylist()]
    return codes, np.concatenate([unpacked(x, np.int32) for x in batch["times"].to_pylist()])


def code_of(context: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return (context * _LEVELS + word) * _LEVELS + pair


# --------------------------------------------------------------------- scoring

@dataclass
class Model:
    total: int             # N, all training tokens
    kinds: int             # V, distinct training tokens
    words: np.ndarray      # codebooks
    pairs: np.ndarray
    weights: np.ndarray    # of the pair estimate, by level of the context word

    def estimates(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per level triple: word estimate, pair estimate, level of the context."""
        level, word, pair = code // _LEVELS**2, code // _LEVELS % _LEVELS, code % _LEVELS
        single = np.where(word > 0, self.words[word], 0.1) / (self.total + 0.1)  # one more kind for the unseen
        pair = np.minimum(pair, len(self.pairs) - 1)     # a false probe may pass the last level
        return single, np.minimum(self.pairs[pair] / np.maximum(self.words[level], 1e-9), 1.0), level

    def log10(self, code: np.ndarray) -> np.ndarray:
        single, pair, level = self.estimates(code)
        weight = self.weights[np.minimum(level, len(self.weights) - 1)]
        return np.log10(weight * pair + (1 - weight) * single)


def fit_weights(triples: DataFrame, model: Model) -> np.ndarray:
    """For each level of the context the weight of the grid with the largest
    likelihood on the texts; the text itself is counted, so one occurrence of
    each pair is left out."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CODES, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCS):
                codes, times = _codes(batch.slice(at, _DOCS))
                total += np.bincount(np.concatenate(codes), times, minlength=_CODES).astype(np.int64)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    rows = (triples.select("codes", "times").mapInArrow(measure, "code bigint, n bigint")
            .groupBy("code").agg(F.sum("n").alias("n")).collect())  # triples of a few dozen levels
    code, n = np.array([r["code"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
    single, pair, level = model.estimates(code)
    pair = np.maximum(pair - 1.0 / np.maximum(model.words[level], 1.0), 0.0)
    best = np.stack([np.bincount(level, n * np.log(w * pair + (1 - w) * single), minlength=len(model.words)) for w in _GRID], 1)
    weights = _GRID[best.argmax(1)]
    weights[0] = 0.0
    return weights


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score), one row per input row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(training, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = stored(word_counts(rows.where("train").select("text")), "lm-words")
    totals = counted.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = totals["n"] or 0, totals["v"]
    divisor = total + 0.1 * (kinds + 1)
    head_rows = counted.where(F.col("c") >= F.lit(max(1.0, HEAD_SHARE * total))).select("w", "c").toLocalIterator()
    head = dict(sorted(((bytes(r["w"]), r["c"]) for r in head_rows), key=lambda x: (-x[1], x[0])))  # at most 1 / HEAD_SHARE words
    blocks_ = stored(number_texts(rows, head, divisor), "lm-blocks")

    shared = docs.sparkSession.sparkContext.broadcast((hashes_of(list(head)), levels_of(np.array(list(head.values()), np.int64))))
    parts, codebook = filter_size(with_levels(counted, 1.0))
    words = stored(word_totals(blocks_, counted, total - sum(head.values()), parts, codebook), "lm-totals")
    pairs, pair_codebook = pair_levels(blocks_, total, shared)
    triples = stored(level_triples(blocks_, words, pairs, total, divisor, shared), "lm-triples")
    model = Model(total, kinds, codebook, pair_codebook, np.zeros(1))
    if total:
        model.weights = fit_weights(triples.where("train"), model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCS):
                some = batch.slice(at, _DOCS)
                each, times = _codes(some)
                doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
                codes, which = np.unique(np.concatenate(each), return_inverse=True)
                sums = np.bincount(doc, times * model.log10(codes)[which], minlength=len(each))
                yield pa.RecordBatch.from_arrays([*(some[c] for c in ("id", "n_tokens", "n_known", "base")), pa.array(sums)],
                                                 names=["id", "n_tokens", "n_known", "base_score", "score"])
        give_back()

    scored = triples.drop("train").mapInArrow(score, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"),
                         "base_score", "score")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = is_rest(F.col("doc_id"), 10, 0)
    scored = score_documents(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
