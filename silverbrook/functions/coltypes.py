"""Classification of column types, column roles and raw values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first group with a fragment inside the type text wins.
TYPE_CATEGORIES = (
    ("INTEGER", ("int",)),
    ("FLOAT", ("double", "float", "decimal", "numeric", "real")),
    ("DATETIME", ("time", "date")),
    ("BOOLEAN", ("bool",)),
    ("UUID", ("uuid",)),
    ("JSON", ("json",)),
    ("STRING", ("char", "text", "str")),
)

# Name fragments that mark money columns.
MONEY_FRAGMENTS = ("spend", "amount", "price", "revenue", "cost", "balance")

# Raw text patterns and the type each stands for, in order of precedence.
TEXT_KINDS = (
    ("bigint", r"^-?\d+$"),
    ("decimal", r"^-?\d*\.\d+$"),
    ("timestamp", r"^\d{4}-\d{2}-\d{2}"),
    ("uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}"),
)


def _has_any(text: Column, fragments) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(f) for f in fragments])


def type_category(type_text: Column) -> Column:
    """Coarse family used to compare types of different engines."""
    t = F.lower(F.coalesce(type_text, F.lit("")))
    family = F.lit("OTHER")
    for name, fragments in reversed(TYPE_CATEGORIES):
        family = F.when(_has_any(t, fragments), name).otherwise(family)
    return family


def semantic_kind(name: Column, type_text: Column) -> Column:
    """Role of a column, from its name and type."""
    n, t = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(type_text, F.lit("")))
    floats = dict(TYPE_CATEGORIES)["FLOAT"]
    return (
        F.when((t == "uuid") | (n == "id") | (n.endswith("_id") & ~t.contains("int")), "identifier")
        .when(t == "date", "date")
        .when(t.contains("time"), "timestamp")
        .when(_has_any(n, MONEY_FRAGMENTS), "financial")
        .when(t.contains("int"), "integer")
        .when(_has_any(t, floats), "float")
        .when(t.contains("bool"), "boolean")
        .when(_has_any(t, ("json", "struct", "map")), "json")
        .when(_has_any(t, ("list", "array")), "list")
        .otherwise("text")
    )


def is_blank_value(text: Column) -> Column:
    """Raw values that make a column nullable."""
    return F.lower(F.coalesce(text, F.lit(""))).isin("", "null")


def text_kind(text: Column) -> Column:
    """Type suggested by one raw text value."""
    kind = F.lit("varchar")
    for name, pattern in reversed(TEXT_KINDS):
        kind = F.when(text.rlike(pattern), name).otherwise(kind)
    return kind


def variant_kind(value: Column) -> Column:
    """Type suggested by one JSON value held as a variant; null stands for JSON null."""
    shape = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    patterns = dict(TEXT_KINDS)
    return (
        F.when(shape == "VOID", F.lit(None))
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "STRING",
              F.when(text.rlike(patterns["timestamp"]), "timestamp")
              .when(text.rlike(patterns["uuid"]), "uuid")
              .otherwise("varchar"))
        .when(shape.startswith("OBJECT") | shape.startswith("ARRAY"), "json")
        .when(number == F.floor(number), "bigint")
        .otherwise("double")
    )
