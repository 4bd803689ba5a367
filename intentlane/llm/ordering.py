"""Positions of rows in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from intentlane.llm.common import materialise


def positions(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``pos``, a row's place (from 0) among the rows of its
    ``group`` in ascending ``order`` (nulls first), and ``total``, the rows of
    the group.

    The rows are range-partitioned by group and order, numbered where they
    lie, and shifted by the rows of the ranges before theirs: the window below
    has one row per range and group. ``order`` should tell rows apart as far
    as possible, since equal rows share a range; the columns ``_mid`` and
    ``_part`` are this function's own. A group may be null only if a row's own
    group is not needed later: give it a non-null key."""
    ranked = materialise(
        df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
        .withColumn("_mid", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_mid", 33)), name)
    runs = ranked.groupBy(group, "_part").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                       F.sum("_n").over(whole).alias("total"))
    return (ranked.join(runs, [group, "_part"])
            .withColumn("pos", F.col("_mid") + F.col("_shift")).drop("_mid", "_part", "_shift"))
