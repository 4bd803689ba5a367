"""String rules of the reference as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from intentlane import params as P

_SIGNED_LONG = r"^[+-]?[0-9]+\z"
# what Java strips (everything up to U+0020) and what it calls white space
_EDGES = r"^[\x00-\x20]+|[\x00-\x20]+\z"
_BLANK = r"^[\t-\r\x1C-\x20\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]*\z"


def parse_user_id(col: Column) -> Column:
    """CTX-2 id rule: the whole string as a signed long, else the second
    '-'-separated piece as a signed long, else NULL. No trimming (the
    reference's parser does not trim), overflow gives NULL."""
    piece = F.get(F.split(col, "-"), 1)
    return (F.when(col.rlike(_SIGNED_LONG), col.try_cast("bigint"))
            .when(col.contains("-") & piece.rlike(_SIGNED_LONG), piece.try_cast("bigint")))


def parse_tags(col: Column) -> Column:
    """JSON array of strings; NULL, blank or malformed text -> empty array."""
    parsed = F.from_json(col, "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def trim(col: Column) -> Column:
    """Strip white space and control characters from both ends."""
    return F.regexp_replace(col, _EDGES, "")


def split_selling_points(col: Column) -> Column:
    """CAT-2 split: full-width and ASCII separators, trimmed, blanks dropped;
    NULL -> empty array."""
    parts = F.split(F.translate(col, "；,", ";;"), ";")
    trimmed = F.transform(parts, trim)
    kept = F.filter(trimmed, lambda x: x != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def price_tier(price: Column) -> Column:
    """CAT-3 tiers by upper bound; a NULL or unreadable price counts as 0.0."""
    p = F.coalesce(price.try_cast("double"), F.lit(0.0))
    tier = F.lit(P.PRICE_TIER_EXPENSIVE)
    for inside, name in ((p <= 500, P.PRICE_TIER_MODERATE), (p <= 300, P.PRICE_TIER_STANDARD),
                         (p < 100, P.PRICE_TIER_AFFORDABLE)):
        tier = F.when(inside, F.lit(name)).otherwise(tier)
    return tier


def merchandising_flags(desc: Column) -> Column:
    """CAT-4 suffixes appended to selling points, in order."""
    d = F.coalesce(desc, F.lit(""))
    low = F.lower(d)
    new = low.contains("new") | d.contains("新品")
    limited = low.contains("limited") | d.contains("限量")
    sale = low.contains("sale") | d.contains("discount") | d.contains("off")
    return F.concat(F.when(new, F.lit(P.FLAG_NEW)).otherwise(F.lit("")),
                    F.when(limited, F.lit(P.FLAG_LIMITED)).otherwise(F.lit("")),
                    F.when(sale, F.lit(P.FLAG_SALE)).otherwise(F.lit("")))


def is_blank(col: Column) -> Column:
    return col.isNull() | col.rlike(_BLANK)


def java_double_str(col: Column) -> Column:
    """String.valueOf(double) for ordinary magnitudes ("10.0", "99.99")."""
    return col.try_cast("double").cast("string")
