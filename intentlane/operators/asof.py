"""Horizon-bounded as-of lookups (GOV-1, DOC-2) without a per-key window.

``prev_within``: for each left row, the latest right row (same keys) with
left.t - horizon < right.t <= left.t. ``next_within``: the earliest right
row with left.t < right.t <= left.t + horizon.

Both sides are partitioned by (keys, time bucket of width >= horizon);
right rows near a bucket edge are copied into the neighbouring bucket, so
every lookup is local to one (key, bucket) group and a hot key is spread
over its buckets. The windows are running frames (O(n) per group)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(left: DataFrame, right: DataFrame, keys: list[str], t_col: str, horizon_us: int,
              bucket_factor: int, forward: bool) -> tuple[DataFrame, int]:
    width = horizon_us * max(1, bucket_factor)
    t = F.col(t_col)
    home = F.floor(t / F.lit(width)).cast("long")
    lft = left.select("*", home.alias("_b"), F.lit(1).alias("_k"),
                      F.lit(None).cast("long").alias("_rt"))
    if forward:
        # right rows within the horizon after a bucket start also serve the previous bucket
        edge = t <= home * F.lit(width) + F.lit(horizon_us)
        other = home - 1
    else:
        # right rows within the horizon before a bucket end also serve the next bucket
        edge = t > (home + 1) * F.lit(width) - F.lit(horizon_us)
        other = home + 1
    # one projection builds the right side in the left side's column order
    fixed = {"_b": F.explode(F.when(edge, F.array(home, other)).otherwise(F.array(home))),
             "_k": F.lit(0), "_rt": F.col(t_col)}
    own = set(keys) | {t_col}
    rgt = right.select(*[
        fixed[f.name].alias(f.name) if f.name in fixed
        else F.col(f.name) if f.name in own
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in lft.schema.fields])
    return lft.unionByName(rgt), width


def prev_within(left: DataFrame, right: DataFrame, keys: list[str], t_col: str, horizon_us: int,
                out_col: str = "prev_t", bucket_factor: int = 4) -> DataFrame:
    """Add ``out_col`` = time of the latest right row in (t - horizon, t]."""
    both, _ = _bucketed(left, right, keys, t_col, horizon_us, bucket_factor, forward=False)
    # right rows (k=0) sort before left rows (k=1) of equal time: right.t <= left.t
    w = (Window.partitionBy(*keys, "_b").orderBy(F.col(t_col), F.col("_k"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.last("_rt", ignorenulls=True).over(w)
    out = both.withColumn(out_col, last).filter(F.col("_k") == 1)
    out = out.withColumn(out_col, F.when(F.col(out_col) > F.col(t_col) - F.lit(horizon_us),
                                         F.col(out_col)))
    return out.drop("_b", "_k", "_rt")


def next_within(left: DataFrame, right: DataFrame, keys: list[str], t_col: str, horizon_us: int,
                out_col: str = "next_t", bucket_factor: int = 4) -> DataFrame:
    """Add ``out_col`` = time of the earliest right row in (t, t + horizon]."""
    both, _ = _bucketed(left, right, keys, t_col, horizon_us, bucket_factor, forward=True)
    # descending running frame; left rows (k=1) sort before right rows of
    # equal time, so right.t == left.t is excluded (strictly after)
    w = (Window.partitionBy(*keys, "_b").orderBy(F.col(t_col).desc(), F.col("_k").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nxt = F.last("_rt", ignorenulls=True).over(w)
    out = both.withColumn(out_col, nxt).filter(F.col("_k") == 1)
    out = out.withColumn(out_col, F.when(F.col(out_col) <= F.col(t_col) + F.lit(horizon_us),
                                         F.col(out_col)))
    return out.drop("_b", "_k", "_rt")
