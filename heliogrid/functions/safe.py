"""Casts and JSON helpers that give null instead of failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_or_null(text: Column) -> Column:
    return text.try_cast("decimal(38,18)")


def int_or_null(value: Column) -> Column:
    """Whole numbers in text; numbers cut towards zero, flags as 1 and 0. "3.9" as text is null."""
    text = value.cast("string")
    whole = F.when(text.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.regexp_replace(F.trim(text), "_", "").try_cast("long"))
    return F.when(F.typeof(value) == "string", whole).otherwise(value.try_cast("long"))


def date_or_null(text: Column) -> Column:
    """A calendar date and nothing else: YYYY-MM-DD or YYYYMMDD."""
    long = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    return F.coalesce(long, F.when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"(\d{4})(\d\d)(\d\d)", "$1-$2-$3").try_cast("date")))


def kind_of(variant: Column) -> Column:
    """Leading word of a variant's type: OBJECT, ARRAY, BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN, VOID."""
    return F.regexp_extract(F.schema_of_variant(variant), r"^\w+", 0)


def number_at(variant: Column, path: str) -> Column:
    """The number at a path as double; strings, booleans and missing values give null."""
    node = F.try_variant_get(variant, path, "variant")
    numeric = kind_of(node).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT")
    return F.when(numeric, F.try_variant_get(variant, path, "double"))


def loose_number_at(variant: Column, path: str) -> Column:
    """The number at a path, or a string that reads as one; booleans give null."""
    node = F.try_variant_get(variant, path, "variant")
    return F.when(kind_of(node) != "BOOLEAN", F.try_variant_get(variant, path, "string").try_cast("double"))


def int_at(variant: Column, path: str) -> Column:
    """``int_or_null`` of the value at a path, by its JSON type."""
    node = F.try_variant_get(variant, path, "variant")
    kind, as_ = kind_of(node), lambda t: F.try_variant_get(node, "$", t)
    return (
        F.when(kind == "STRING", int_or_null(as_("string")))
        .when(kind.isin("BIGINT", "INT", "BOOLEAN"), as_("long"))
        .when(kind.isin("DECIMAL", "DOUBLE", "FLOAT"), as_("double").try_cast("long"))
    )


def date_at(variant: Column, path: str) -> Column:
    """``date_or_null`` of a string at a path; other types give null."""
    node = F.try_variant_get(variant, path, "variant")
    return F.when(kind_of(node) == "STRING", date_or_null(F.try_variant_get(node, "$", "string")))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent within 0..100, one decimal; null where there is no whole."""
    return F.when(whole > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), part * 100.0 / whole)), 1))
