"""Time columns as epoch microseconds (LongType), independent of the session
time zone: the driver's tables carry ``timestamp_ntz`` values, read as UTC
wall time."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

US_PER_DAY = 86_400_000_000


def ntz_epoch_us(c: Column) -> Column:
    """Epoch microseconds of a ``timestamp_ntz`` taken as UTC wall time, from
    its date and time fields (no cast through the session time zone, which
    would shift values across daylight-saving changes)."""
    secs = F.date_part(F.lit("SECOND"), c)          # decimal seconds with micros
    return (F.unix_date(F.to_date(c)).cast("long") * F.lit(US_PER_DAY)
            + F.hour(c).cast("long") * F.lit(3_600_000_000)
            + F.minute(c).cast("long") * F.lit(60_000_000)
            + (secs * F.lit(1_000_000)).cast("long"))


def epoch_us(col: Column | str, dtype=None) -> Column:
    """Epoch microseconds of a timestamp (instant) or timestamp_ntz column."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, TimestampType):
        return F.unix_micros(c)
    return ntz_epoch_us(c)


def epoch_us_of(df, name: str) -> Column:
    """``epoch_us`` dispatching on the column's declared type."""
    return epoch_us(F.col(name), df.schema[name].dataType)


def time_literal(us: int, dtype) -> Column:
    """A literal of the column's own type for ``us`` (so comparisons with the
    raw column reach the parquet scan as pushed filters)."""
    if isinstance(dtype, TimestampNTZType):
        text = datetime.fromtimestamp(us / 1e6, tz=timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
        return F.lit(text).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(us))


def epoch_number_to_us(num: Column) -> Column:
    """Wire timestamps arrive as epoch seconds (possibly fractional) or epoch
    milliseconds; values below 1e11 are seconds (1e11 s is year 5138, 1e11 ms
    is 1973)."""
    return (F.when(num < F.lit(1e11), F.round(num * F.lit(1e6)))
            .otherwise(F.round(num * F.lit(1e3)))).cast("long")


def raw_time_range(df, col: str, lo_us: int | None = None, hi_us: int | None = None,
                   hi_inclusive: bool = False) -> Column:
    """``lo_us <= col < hi_us`` (or ``<=``) on the raw time column, with
    literals of its own type so the predicate is pushed to the scan."""
    dtype = df.schema[col].dataType
    cond = F.lit(True)
    if lo_us is not None:
        cond = cond & (F.col(col) >= time_literal(lo_us, dtype))
    if hi_us is not None:
        hi = time_literal(hi_us, dtype)
        cond = cond & ((F.col(col) <= hi) if hi_inclusive else (F.col(col) < hi))
    return cond
