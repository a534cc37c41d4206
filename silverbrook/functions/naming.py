"""Identifier rules: column names, table names, tenant slugs and display names.

Each rule exists as a Column expression so it can run over a registry of names. The
column cleaner also has a driver-side form, because schema fields are driver metadata.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names shown for the four tenants known in advance.
KNOWN_TENANT_NAMES = {
    "tenant_acme": "Acme Corp (EU-Prod)",
    "tenant_globex": "Globex Corporation",
    "tenant_a": "Tenant Alpha",
    "tenant_b": "Tenant Beta",
}

# Fixed value: the placeholder table name nobody may ingest into.
PLACEHOLDER_TABLE = "dataset"

_EDGE_UNDERSCORES = "^_+|_+$"


def clean_column(name: Column) -> Column:
    """Lower snake case: runs of anything but letters and digits become one underscore."""
    snake = F.regexp_replace(name, r"[^\p{L}\p{N}]+", "_")
    return F.lower(F.regexp_replace(snake, _EDGE_UNDERSCORES, ""))


def clean_name(name: str) -> str:
    """``clean_column`` for one schema field."""
    return re.sub(r"[\W_]+", "_", name).strip("_").lower()


def unique_names(names: Iterable[str]) -> list[str]:
    """Cleaned field names, made usable as a schema.

    A name that cleans to nothing becomes ``col_<position>``; a repeated name gets the
    first free ``_1``, ``_2`` … suffix.
    """
    cleaned = [clean_name(n) or f"col_{i}" for i, n in enumerate(names, start=1)]
    reserved, used, out = set(cleaned), set(), []
    for name in cleaned:
        candidate, n = name, 0
        while candidate in used or (n and candidate in reserved):
            n += 1
            candidate = f"{name}_{n}"
        used.add(candidate)
        out.append(candidate)
    return out


def clean_columns(df: DataFrame) -> DataFrame:
    """Rename every column by position, so awkward characters need no escaping."""
    return df.toDF(*unique_names(df.columns))


def web_name(name: Column) -> Column:
    """The matcher's column key: ASCII only, underscores trimmed but not collapsed."""
    key = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9_]", "_")
    return F.regexp_replace(key, _EDGE_UNDERSCORES, "")


def ingest_table_name(requested: Column) -> Column:
    """Target table of an upload."""
    return web_name(F.btrim(requested))


def is_valid_table_name(requested: Column) -> Column:
    """Whether an upload may use the requested target."""
    cleaned = ingest_table_name(requested)
    placeholder = F.lower(F.btrim(F.coalesce(requested, F.lit("")))).isin("", PLACEHOLDER_TABLE)
    return ~placeholder & (F.length(cleaned) >= 2)


def gold_object_name(requested: Column) -> Column:
    """Gold names keep their outer underscores."""
    return F.lower(F.regexp_replace(F.btrim(requested), "[^a-zA-Z0-9_]", "_"))


def tenant_slug(slug: Column, name: Column) -> Column:
    """Registry key of a tenant, derived from its name when no slug is given."""
    runs = "[^a-z0-9_-]+"
    given = F.lower(F.btrim(F.coalesce(slug, F.lit(""))))
    given = F.regexp_replace(F.regexp_replace(given, runs, "_"), _EDGE_UNDERSCORES, "")
    derived = F.regexp_replace(F.lower(F.btrim(name)), runs, "_")
    return (
        F.when(given == "", F.concat(F.lit("tenant_"), derived))
        .when(given.startswith("tenant_"), given)
        .otherwise(F.concat(F.lit("tenant_"), given))
    )


def friendly_tenant_name(slug: Column) -> Column:
    """Display name: underscores to blanks, first letter of every word in capitals."""
    pieces = F.split(F.replace(slug, F.lit("_"), F.lit(" ")), "(?<=[^A-Za-z0-9])")
    titled = F.array_join(
        F.transform(pieces, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), ""
    )
    known = F.create_map(*[F.lit(x) for pair in KNOWN_TENANT_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, slug), titled)
