"""JSON decoding helpers over Spark's VARIANT type (``try_parse_json``):
exact truthiness and key-presence tests that ``from_json`` cannot give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(col: Column) -> Column:
    """VARIANT or NULL when the text is not valid JSON."""
    return F.try_parse_json(col)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def get(v: Column, path: str, dtype: str = "string") -> Column:
    return F.try_variant_get(v, path, dtype)


def present(v: Column, path: str) -> Column:
    """Key exists (an explicit JSON null counts as present)."""
    return F.try_variant_get(v, path, "variant").isNotNull()


def truthy_str(v: Column, path: str) -> Column:
    """``str(x)`` when the JSON value x is truthy in Python terms, else NULL:
    non-empty string, non-zero number, true, non-empty array/object."""
    typ = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    s = F.try_variant_get(v, path, "string")
    num = F.try_variant_get(v, path, "double")
    return (F.when(typ == "STRING", F.when(s != "", s))
            .when(typ.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.when(num != 0, s))
            .when(typ.startswith("DECIMAL") | typ.isin("DOUBLE", "FLOAT"),
                  F.when(num != 0, num.cast("string")))
            .when(typ == "BOOLEAN", F.when(s == "true", F.lit("True")))
            .when(typ.startswith("ARRAY") | typ.startswith("OBJECT"),
                  F.when(~F.to_json(F.try_variant_get(v, path, "variant")).isin("[]", "{}"),
                         F.to_json(F.try_variant_get(v, path, "variant")))))
