"""Spelling variants by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point makes them
equal, that is, if their common prefix and suffix together reach the longer
length minus one. Both lengths come from dense comparisons: the code points of
a block of words are a padded matrix, aligned left for prefixes and (reversed)
for suffixes, and two blocks are compared at once.

Only blocks that can hold near words meet. A single edit falls into one of
``PIECES`` parts of a word, so near words agree before and after that part.
Every word takes part as the shorter and as the longer one, under one key per
part; keys are shuffled, and a task compares the sorted rows of its keys in
tiles. A key with more than ``TILE_WORDS`` words is cut into blocks whose pairs
are tasks' work of their own, so no key is one task and none is cut short. A
pair is given by the first part that both agree on, hence once.

Words are counted after combining per task, so a word that makes up a third of
all text is one row per task. Nulls: a null text has no word, a null id counts
as an empty one in the hash. Runs of any length are taken whole; the size of
a tile follows from the longest word in it. Of near words with equal counts the
smallest in code point order is the form. An empty table gives an empty result;
repeated rows count each time; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from intentlane.llm.common import materialise, table
from intentlane.llm.merkle import LOWER, UPPER

RUN_REGEX = "[A-Za-zÀ-ÿ]+"
SLIP_MODULUS = 97
MIN_LENGTH = 5
MIN_COUNT = 3
PIECES = 4
TILE_WORDS = 4096           # words of a key compared in one task
TILE_CELLS = 1 << 21        # cells of a comparison held at once


def runs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = None) -> DataFrame:
    """(word) per run of letters; with ``slips``, runs whose hash it divides lose one code point."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                       F.explode(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(RUN_REGEX), 0)).alias("run"))
    if slips is None:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat(F.col("_id"), F.lit(":"), F.col("run")).cast("binary"))
    hashed = runs.select("run", h.alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run").cast("bigint")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % slips == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    return (words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def part_keys(words: DataFrame) -> DataFrame:
    """(word, n, size, part, key): a word is in class ``size`` with its own
    length, as the shorter word of a pair or one of two equally long ones, and
    with its length minus one, as the longer."""
    length = F.char_length("word")
    classes = words.select("word", "n", length.alias("length"), F.explode(F.array(length, length - 1)).alias("size"))
    parts = classes.where("size > 0").withColumn("part", F.explode(F.array(*[F.lit(q) for q in range(PIECES)])))
    first = F.floor(F.col("part") * F.col("size") / PIECES).cast("int")
    after = F.col("size") - F.floor((F.col("part") + 1) * F.col("size") / PIECES).cast("int")
    key = F.xxhash64("size", "part", F.substring("word", F.lit(1), first),
                     F.substring("word", F.col("length") - after + 1, after))
    return parts.select("word", "n", "size", "part", key.alias("key"))


def deal(keys: DataFrame, tile_words: int) -> DataFrame:
    """Adds ``unit`` and ``block``: keys of up to ``tile_words`` words are one
    unit; larger ones are cut into blocks, and each pair of blocks is a unit."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > tile_words)
    large = sizes.select("key", F.ceil(F.col("words") / (tile_words // 2)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("word"), F.col("blocks").cast("bigint")).cast("int")
    rows = keys.join(large, "key", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(block))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    pair = F.least("block", "other") * F.coalesce("blocks", F.lit(1)) + F.greatest("block", "other")
    return (rows.withColumn("other", F.explode(others)).withColumn("own", F.col("block") == F.col("other"))
            .withColumn("unit", pair.cast("bigint")).drop("blocks", "other"))


class Words:
    """Code points of words, padded, aligned left and (reversed) right."""

    def __init__(self, words: list[str], width: int):
        self.lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(self.lengths) - self.lengths
        row = np.repeat(np.arange(len(words)), self.lengths)
        col = np.arange(len(flat)) - np.repeat(starts, self.lengths)
        kind = np.uint8 if not len(flat) or flat.max() < 256 else np.uint32
        self.left = np.zeros((len(words), width), kind)
        self.right = np.zeros((len(words), width), kind)
        self.left[row, col] = flat
        self.right[row, self.lengths[row] - 1 - col] = flat

    def common(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common prefix and suffix lengths of the words ``a`` and ``b``, which differ pairwise."""
        return (self.left[a] != self.left[b]).argmax(axis=1), (self.right[a] != self.right[b]).argmax(axis=1)


def near(prefix: np.ndarray, suffix: np.ndarray, longer: np.ndarray) -> np.ndarray:
    return prefix + suffix >= longer - 1


def _tiles(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of row blocks (a, b, c, d): rows a to b against rows c to d. Keys
    that fit go together into one block against itself; a larger one gives
    all pairs of its blocks."""
    k = 0
    while k < len(bounds) - 1:
        j = k + 1
        while j < len(bounds) - 1 and bounds[j + 1] - bounds[k] <= most:
            j += 1
        a, b = bounds[k], bounds[j]
        if b - a <= most:
            yield a, b, a, b
        else:
            cuts = [*range(a, b, most), b]
            for x in range(len(cuts) - 1):
                for y in range(x, len(cuts) - 1):
                    yield cuts[x], cuts[x + 1], cuts[y], cuts[y + 1]
        k = j


def _pairs(rows: dict[str, np.ndarray], texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs among rows of one class, sorted by key and unit; each by the first part both agree on."""
    width = size + 2
    cuts = np.flatnonzero((np.diff(rows["key"]) != 0) | (np.diff(rows["unit"]) != 0)) + 1
    group = np.zeros(len(texts), np.int64)
    group[cuts] = 1
    group = np.cumsum(group)
    bounds = np.concatenate(([0], cuts, [len(texts)]))
    most = max(2, min(256, int((TILE_CELLS / width) ** 0.5) * 2, TILE_CELLS // (4 * width)))
    ends = np.array([(q + 1) * size // PIECES for q in range(PIECES)], np.int64)
    found_a, found_b = [], []
    for a, b, c, d in _tiles(bounds, most):
        if b - a < 2 and (a, b) == (c, d):
            continue
        held = Words(texts[a:b] if (a, b) == (c, d) else texts[a:b] + texts[c:d], width)
        shift = 0 if (a, b) == (c, d) else b - a
        one, two = slice(a, b), slice(c, d)
        meet = group[one][:, None] == group[two][None, :]
        if not shift:
            meet = np.triu(meet, 1)
        # two longer words are a pair of the next class; words of one block of a large key meet in its own unit
        meet &= (held.lengths[:b - a, None] == size) | (held.lengths[None, shift:shift + d - c] == size)
        meet &= (rows["block"][one][:, None] != rows["block"][two][None, :]) | (rows["own"][one][:, None] & rows["own"][two][None, :])
        left, right = np.nonzero(meet)
        step = max(1, TILE_CELLS // width)
        for k in range(0, len(left), step):
            i, j = left[k:k + step], right[k:k + step] + shift
            prefix, suffix = held.common(i, j)
            longer = np.maximum(held.lengths[i], held.lengths[j])
            agree = (prefix[:, None] >= (np.concatenate(([0], ends[:-1])))[None, :]) & (suffix[:, None] >= (size - ends)[None, :])
            ok = near(prefix, suffix, longer) & (agree.argmax(axis=1) == rows["part"][a + i])
            found_a.append(a + i[ok])
            found_b.append((c if shift else a) + j[ok] - shift)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


COLUMNS = ("size", "key", "unit", "part", "block", "own")


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways round, of rows sorted by class, key and unit."""
    rest: pa.Table | None = None

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = rows["size"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(sizes)]
        for first, past in zip(cuts, cuts[1:]):
            if past - first < 2:
                continue
            here = rows.slice(first, past - first).combine_chunks()
            columns = {c: here[c].to_numpy() for c in COLUMNS}
            a, b = _pairs(columns, here["word"].to_pylist(), int(sizes[first]))
            if not len(a):
                continue
            one, two = pa.array(np.concatenate((a, b))), pa.array(np.concatenate((b, a)))
            word, n = here["word"].chunk(0), here["n"].chunk(0)
            yield pa.RecordBatch.from_arrays([word.take(one), word.take(two), n.take(two)], names=["word", "near", "near_n"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        if not rows.num_rows:
            continue
        key, unit = rows["key"].to_numpy(), rows["unit"].to_numpy()
        ends = np.flatnonzero((np.diff(key) != 0) | (np.diff(unit) != 0))
        whole = int(ends[-1]) + 1 if len(ends) else 0
        rest = rows.slice(whole)
        if whole:
            yield from emit(rows.slice(0, whole))
    if rest is not None and rest.num_rows:
        yield from emit(rest)


def near_words(words: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """(word, near, near_n) for every ordered pair of near words of (word, n)."""
    rows = deal(part_keys(words), tile_words).select("word", "n", *COLUMNS)
    return (rows.repartition("key", "unit").sortWithinPartitions("size", "key", "unit")
            .mapInArrow(compare, "word string, near string, near_n bigint"))


def last_form(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling over (word, form): after k rounds a
    pointer spans 2 ** k forms. Counts at least double along a chain, so it
    ends and has few links."""
    ways = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = ways.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        joined = materialise(ways.join(ahead, F.col("root") == F.col("_at"), "left")
                             .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")),
                             "spelling-roots")
        ways = joined.drop("_moved")
        if joined.where("_moved").limit(1).count() == 0:
            return ways


def group_variants(words: DataFrame, ratio: int = 2, tile_words: int = TILE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for (word, n), one row per word."""
    words = materialise(words, "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    nearest = near_words(words, tile_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    grouped = materialise(
        words.join(nearest, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = last_form(grouped.where(F.col("form").isNotNull()).select("word", "form"))
    return grouped.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(runs_of(table(spark, sf_dir, "documents"), slips=SLIP_MODULUS)))
