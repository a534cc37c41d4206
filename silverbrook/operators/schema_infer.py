"""Column type inference over raw text and raw JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverbrook.functions.coltypes import is_blank_value, text_kind, variant_kind
from silverbrook.session import spread

# Fixed value: shown when a column has no sample value.
NO_SAMPLE = "—"

# Every type a JSON value may suggest.
JSON_KINDS = ("bigint", "double", "boolean", "json", "timestamp", "uuid", "varchar")


def infer_text(df: DataFrame, mode: str = "all") -> DataFrame:
    """Type, nullability and a sample for every (string) column of ``df``.

    ``all`` looks at every row: a type holds if all non-blank values agree on it, otherwise
    the column is varchar. ``first_row`` decides on the first row alone. All columns are
    profiled in one aggregate; rows are never unpivoted, so one small row per task is
    shuffled.
    """
    if mode == "first_row":
        df = df.limit(1)
    aggregates = []
    for i, name in enumerate(df.columns):
        value = F.btrim(F.col(f"`{name}`").cast("string"))
        blank = is_blank_value(value)
        kind = F.when(~blank, text_kind(value))
        aggregates += [
            F.min(kind).alias(f"lo{i}"), F.max(kind).alias(f"hi{i}"),
            F.bool_or(blank).alias(f"null{i}"), F.min(F.when(~blank, value)).alias(f"sample{i}"),
        ]
    wide = df.agg(*aggregates)
    rows = [
        F.struct(
            F.lit(i + 1).alias("ordinal"), F.lit(name).alias("name"),
            F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise("varchar").alias("type"),
            F.coalesce(f"null{i}", F.lit(True)).alias("nullable"),
            F.coalesce(f"sample{i}", F.lit(NO_SAMPLE)).alias("sample"),
        )
        for i, name in enumerate(df.columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def infer_json(df: DataFrame, document: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Type and nullability of every top-level JSON key, optionally per group.

    A key is nullable when it is null or absent in at least one record. Malformed
    documents are left out.
    """
    docs = spread(df).select(*keys, F.try_parse_json(F.col(document)).alias("_doc")).filter(F.col("_doc").isNotNull())
    fields = df.sparkSession.tvf.variant_explode(F.col("_doc").outer())
    entries = docs.lateralJoin(fields).select(*keys, F.col("key").alias("name"), F.col("value").alias("_value"))
    # Kinds are compared as numbers, which keeps the aggregate hash-based.
    code = F.nullif(F.array_position(F.array(*[F.lit(k) for k in JSON_KINDS]), F.col("kind")), F.lit(0))
    kinds = entries.select(*keys, "name", variant_kind(F.col("_value")).alias("kind")).withColumn("code", code)
    seen = kinds.groupBy(*keys, "name").agg(
        F.min("code").alias("lo"), F.max("code").alias("hi"), F.count("code").alias("n_set"))
    if keys:
        totals = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"))
        seen = seen.join(totals, list(keys))
    else:
        seen = seen.withColumn("n_docs", docs.agg(F.count(F.lit(1))).scalar())
    return seen.select(
        *keys, "name",
        F.when(F.col("lo") == F.col("hi"), F.element_at(F.array(*[F.lit(k) for k in JSON_KINDS]), F.col("lo").cast("int")))
        .otherwise("varchar").alias("type"),
        (F.col("n_set") < F.col("n_docs")).alias("nullable"))


def column_profile(df: DataFrame) -> DataFrame:
    """Columns of a typed DataFrame (for example a Parquet footer) in the same shape."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, start=1)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, name string, type string, nullable boolean")
