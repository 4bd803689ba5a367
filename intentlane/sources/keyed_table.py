"""SNK-4, SNK-3, CAT-6, CAT-7: a keyed table that is upserted in place, by
hash buckets.

A row lies in the folder of its key's bucket. An upsert reduces the batch to
one row per key, reads only the buckets that the batch touches, and replaces
those folders (dynamic partition overwrite); the rest is not read or written.
So a batch of few keys costs its buckets, whatever the size of the table. The
number of buckets is fixed when the table is made, from the rows expected, and
recorded beside it.

Replacing a folder that is being read is not safe, so the new content is
written to a staging folder first and moved into place by a second
write of that folder only; a job that fails before leaves the table as it
was, one that fails in between is repeated by its batch id. A batch is
applied once: ``applied`` holds its id, and a repeated id is skipped."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def last_per_key(batch: DataFrame, key: str, seq: Column | None = None) -> DataFrame:
    """One row per key, null keys dropped: the one with the largest ``seq``, of
    equal ones the largest by its content, so the choice does not depend on
    the order of rows. Combined per task before the shuffle."""
    whole = F.struct(*batch.columns)
    order = F.struct(*([seq] if seq is not None else []), F.to_json(whole))
    return (batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
            .agg(F.max_by(whole, order).alias("_row")).select("_row.*"))


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # -- what it holds ------------------------------------------------------------

    def _meta(self) -> dict | None:
        try:
            row = self.spark.read.schema("buckets int, ddl string").parquet(f"{self.path}/meta").first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return row.asDict() if row else None

    def exists(self) -> bool:
        return self._meta() is not None

    def read(self) -> DataFrame:
        """The table. A filter on ``bucket`` prunes folders."""
        meta = self._meta()
        if meta is None:
            raise ValueError(f"no table at {self.path}")
        return self.spark.read.schema(f"{meta['ddl']}, bucket int").parquet(f"{self.path}/rows")

    def lookup(self, keys: list) -> DataFrame:
        """The rows of some keys; reads their buckets only."""
        meta = self._meta()
        wanted = self.spark.createDataFrame([(k,) for k in keys], f"k {self.read().schema[self.key].dataType.simpleString()}")
        buckets = sorted({r[0] for r in wanted.select(bucket_of(F.col("k"), meta["buckets"])).collect()})
        return self.read().where(F.col("bucket").isin(buckets) & F.col(self.key).isin(keys)).drop("bucket")

    # -- changes ------------------------------------------------------------------

    def create(self, like: DataFrame, expected_rows: int, buckets: int | None = None) -> None:
        """An empty table with the columns of ``like``."""
        n = buckets or max(1, math.ceil(expected_rows / ROWS_PER_BUCKET))
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
        self.spark.createDataFrame([(n, ddl)], "buckets int, ddl string").coalesce(1).write.parquet(f"{self.path}/meta")
        like.limit(0).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{self.path}/rows")

    def _applied(self, batch_id: str) -> bool:
        try:
            return self.spark.read.schema("n_buckets int").parquet(f"{self.path}/applied/{batch_id}").count() > 0
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    def upsert(self, batch: DataFrame, batch_id: str, seq: Column | None = None, merge: dict[str, Column] | None = None) -> list[int]:
        """Rows of the batch replace rows of the same key; returns the buckets
        written. ``merge`` gives columns of the result from the old row
        (``old.x``, null for a new key) and the new one (``new.x``)."""
        if self._applied(batch_id):
            return []
        meta = self._meta()
        names = [f.name for f in self.read().schema.fields if f.name != "bucket"]
        staged = f"{self.path}/staged/{batch_id}"
        # the batch once, dealt by bucket: what its upsert reads below
        (last_per_key(batch.select(*names), self.key, seq).withColumn("bucket", bucket_of(F.col(self.key), meta["buckets"]))
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{staged}/batch"))
        schema = f"{meta['ddl']}, bucket int"
        new = self.spark.read.schema(schema).parquet(f"{staged}/batch")
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())      # at most the number of buckets
        old = self.read().where(F.col("bucket").isin(touched))
        joined = old.alias("old").join(new.alias("new"), [F.col("old.bucket") == F.col("new.bucket"), F.col(f"old.{self.key}") == F.col(f"new.{self.key}")], "full_outer")
        hit = F.col("new.bucket").isNotNull()
        out = [F.when(hit, (merge or {}).get(c, F.col(f"new.{c}"))).otherwise(F.col(f"old.{c}")).alias(c) for c in names]
        merged = joined.select(*out, F.coalesce("new.bucket", "old.bucket").alias("bucket"))
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{staged}/rows")
        # into place: only the folders of these buckets are replaced
        (self.spark.read.schema(schema).parquet(f"{staged}/rows").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows"))
        self.spark.createDataFrame([(len(touched),)], "n_buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/applied/{batch_id}")
        return touched
