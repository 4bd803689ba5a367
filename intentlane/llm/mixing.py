"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. Per source, words are summed by the leading
hash digits; a running sum over those few buckets finds the bucket in which the
budget runs out, and only that bucket is split by the next digits, until one
hash value is left. Documents below the threshold are taken, so nothing is
sorted, and a larger budget only adds documents (thresholds are nested).

Nulls: a null text has size 0, a null source is a source of its own, ordered
last, and a null doc_id hashes like an empty one. Rows that repeat a doc_id
share its hash; at the threshold they share what is left in proportion to their
sizes. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from intentlane.llm.common import WORD_REGEX, materialise, table

HASH_DIGITS = 15        # hexadecimal digits of the hash
DIGITS_PER_LEVEL = 3    # 4096 buckets a level


def _source_key(source: Column) -> Column:
    """A non-null join key: null and the empty source stay apart."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """Targets per source from (skey, source, source_size).

    The budget (a share of all words) is dealt by weight; a target stops at
    ``most`` times its source's size and the excess goes to the others by
    weight. So target = min(cap, level * weight) for one level, found by
    ordering the sources by cap / weight. One row per source: small windows."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = (sizes.withColumn("weight", w)
              .withColumn("cap", F.col("source_size") * F.lit(float(most)))
              .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
              .withColumn("all_weight", F.sum("weight").over(everything)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (ranked
              .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
              .withColumn("capped_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
              .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("capped_weight")))
              # the level of the first source whose cap is not reached holds for it and all after it
              .withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
              .withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("capped_weight"), F.col("level"))))
                          .over(everything)["level"]))
    return ranked.select(
        "skey", "source", "source_size",
        F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, most: int = 2) -> DataFrame:
    """(id, source, size, source_size, target, taken), one row per document.

    A source whose target is r times its size takes every document floor(r)
    times and the documents below the hash threshold once more; the document
    on the threshold gives the words still missing."""
    sized = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _source_key(F.col(source_col)).alias("skey"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_REGEX)), F.lit(0)).cast("bigint").alias("size"),
            F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, HASH_DIGITS).alias("h")),
        "mix-sized")
    sources = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, budget, most)
    whole = F.least(F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12)), F.lit(most)).cast("bigint")
    bound = materialise(
        targets.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(F.lit(0).cast("bigint")))
        .withColumn("missing", F.greatest(
            F.round(F.col("target") - F.col("whole") * F.col("source_size"), 6), F.lit(0.0)))
        .withColumn("prefix", F.lit("")).withColumn("held", F.lit(0).cast("bigint")), "mix-bound")
    for level in range(DIGITS_PER_LEVEL, HASH_DIGITS + 1, DIGITS_PER_LEVEL):
        bound = materialise(_refine(sized, bound, level), "mix-bound")
    bound = bound.select("skey", "source_size", "target", "whole", "missing", "prefix", "held")
    extra = (F.when(F.col("h") < F.col("prefix"), F.col("size"))
             .when((F.col("h") == F.col("prefix")) & (F.col("held") > 0),
                   F.floor(F.col("size") * F.col("missing") / F.col("held")))
             .otherwise(F.lit(0)))
    return sized.join(bound, "skey").select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + extra).cast("bigint").alias("taken"))


def _refine(sized: DataFrame, bound: DataFrame, digits: int) -> DataFrame:
    """One level down: in each source's boundary bucket, sum words by the next
    digits and keep the bucket where the missing words run out. ``prefix`` is
    past every hash when the bucket has fewer words than are missing."""
    state = [c for c in bound.columns if c not in ("prefix", "held", "missing")]
    inside = (sized.select("skey", "h", "size").join(bound.select("skey", "prefix"), "skey")
              .where(F.col("h").startswith(F.col("prefix")))
              .groupBy("skey", F.substring("h", 1, digits).alias("bucket")).agg(F.sum("size").alias("words")))
    running = Window.partitionBy("skey").orderBy("bucket")
    filled = (inside.withColumn("upto", F.sum("words").over(running))
              .join(bound, "skey", "right")
              .where(F.col("bucket").isNull() | (F.col("upto") > F.col("missing"))))
    # first bucket that holds more than is missing; none: the threshold is past all of them
    first = filled.groupBy("skey").agg(F.min(F.struct("bucket", "words", "upto")).alias("f"))
    return (bound.join(first, "skey", "left")
            .select(*state,
                    F.coalesce(F.col("f.bucket"), F.lit("g")).alias("prefix"),
                    F.coalesce(F.col("f.words"), F.lit(0)).cast("bigint").alias("held"),
                    F.when(F.col("f.bucket").isNotNull(), F.col("missing") - (F.col("f.upto") - F.col("f.words")))
                    .otherwise(F.col("missing")).alias("missing")))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source")
