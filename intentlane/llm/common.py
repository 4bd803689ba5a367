"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from intentlane.session import scratch_path

#: every ASCII byte that is no letter becomes a space; bytes above 0x7F stay
NON_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
#: every ASCII byte that is neither letter nor digit becomes a space
NON_ALNUM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

#: white space and words as the contracts define them
WORD_REGEX = r"[^\x20\x09-\x0D]+"


#: text held as Python objects at once, in bytes
SLICE_BYTES = 2 << 20


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of a string column of about ``most`` bytes each (a
    longer text is a part of its own), so that a worker's memory does not follow
    the rows of an Arrow batch. An empty column gives no part."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, first = np.cumsum(sizes), 0
    while first < len(texts):
        before = upto[first - 1] if first else 0
        past = max(first + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield texts.slice(first, past - first)
        first = past


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parquet options for rows of large values: a page, and a row group, which a reader holds whole, ends after a few MB.
#: Without them the writer first looks at their size after 100 rows, whatever these take.
SMALL_ROW_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1"}


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back:
    cuts lineage, survives lost executors, and gives joins a scan whose
    shuffles adaptive execution can split. ``options`` are the writer's."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, records: int = 1_000):
    """Arrow batches of at most so many rows for the jobs run inside, so that a
    batch of long texts takes little memory on both sides; the session's own
    setting is back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(records))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def crc_rest(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus`` (null for a null key)."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def is_rest(key: Column, modulus: int, rest: int) -> Column:
    """Whether the crc32 remainder is ``rest``; false for a null key."""
    return F.coalesce(crc_rest(key, modulus) == F.lit(rest), F.lit(False))


def hash_share(seed: str, *cols: Column) -> Column:
    """A reproducible number in [0, 1) per row, for bounded training samples."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1_000_000_007)) / F.lit(1_000_000_007)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int,
                    max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of labelled rows outside the held-out fold.

    At most ``max_rows`` rows, those with the smallest hashes of their id, so
    the sample is the same on every run. Rows with a null id, text or label are
    no training rows; a doc_id with conflicting labels takes the larger one, and
    a doc_id that several documents share gives one row, with the text of the
    smallest hash, however many they are. The sampled ids are broadcast: their
    number is bounded by ``max_rows``."""
    rows = (labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()
                         & ~is_rest(F.col(id_col), modulus, held_out))
            .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label")))
    rows = rows.orderBy(hash_share("labelled", F.col("_id")), "_id").limit(max_rows)
    found = (docs.where(F.col(text_col).isNotNull())
             .select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
             .join(F.broadcast(rows), "_id"))
    return found.groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"), F.max("label").alias("label"))
