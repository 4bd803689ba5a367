"""Connected components of a link table by alternating large-star and
small-star contraction.

Every round only takes minima per node (combined before the shuffle) and joins
them back. The minima are written before each join, so that both join inputs
are plain scans and adaptive execution can split the rows of a hub node over
several tasks. Nothing is collected; the driver sees a count and a checksum per
round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from intentlane.llm.common import materialise


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def _least(edges: DataFrame) -> DataFrame:
    return materialise(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")), "star-min")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` (two bigint columns); root is
    the smallest node reachable. Self links and repeats are ignored, null ends
    drop the link, and an empty table gives an empty result."""
    edges = materialise(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "star-edges")
    before = _signature(edges)
    while before[0]:
        # large star: the larger neighbours of a node move to its least neighbour
        least = _least(edges)
        large = materialise(
            edges.join(least, edges["lo"] == least["node"], "left")
            .select("hi", F.coalesce("least", "lo").alias("lo")), "star-large")
        # small star: the smaller neighbours of a node, and the node, move to the least of them
        least = _least(large)
        joined = large.join(least, large["hi"] == least["node"])
        edges = materialise(
            joined.select(F.explode(F.array(
                F.struct(F.col("hi"), F.col("least").alias("lo")),
                F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo").where("hi <> lo").distinct(), "star-edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    return roots.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
