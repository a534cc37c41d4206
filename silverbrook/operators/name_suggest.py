"""Table-name suggestions for incoming files, from file names and column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverbrook.functions.naming import PLACEHOLDER_TABLE, web_name
from silverbrook.session import each, spread

# Patterns removed from a file name, in this order.
EXTENSION = r"(?i)\.(csv|parquet|json|ndjson|tsv|txt)$"
DATE_STAMP = r"[\-_]?(?:20\d{2}[-_]?\d{2}[-_]?\d{2}|\d{10,13})"
VERSION_TAG = r"(?i)[\-_]?(?:v\d+|export|backup|raw|final|sample|data|dataset|dump|output)"

# Table name implied by a well-known identifier column.
ID_TABLES = {
    "student_id": "students", "customer_id": "customers", "user_id": "users",
    "account_id": "accounts", "order_id": "orders", "product_id": "products",
    "item_id": "items", "employee_id": "employees", "patient_id": "patients",
    "vehicle_id": "vehicles", "invoice_id": "invoices", "transaction_id": "transactions",
    "event_id": "events", "session_id": "sessions", "ticket_id": "tickets",
    "device_id": "devices", "log_id": "logs",
}

# Names suggested when any one of the fragment groups is fully present.
DOMAIN_RULES = (
    ((("exam",), ("gpa",), ("grade",), ("study",), ("education",)), ("student_performance", "academic_records")),
    ((("order",), ("price", "quantity")), ("orders", "sales_transactions")),
    ((("spend",), ("monthly",), ("subscription",), ("tier",)), ("customer_subscriptions",)),
    ((("lat",), ("lon",), ("city",), ("country",)), ("locations",)),
    ((("event",), ("action",), ("payload",)), ("activity_events",)),
    ((("salary",), ("department",), ("hire_date",)), ("employees",)),
)

# Names never suggested, and what is offered when nothing else is left.
REJECTED_NAMES = ("dataset", "data", "file", "table", "temp", "test", "export")
FALLBACK_NAMES = ("ingested_records", "source_data", "imported_table")
MAX_SUGGESTIONS, MIN_LENGTH = 5, 3

# Sort position of a suggestion: step * STEP + position within the step.
STEP, FALLBACK_STEP = 1 << 56, 5

_EDGES = "^_+|_+$"


def _snake(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), _EDGES, "")


def clean_base(filename: Column) -> Column:
    """File name without extension, dates and version tags, in snake case."""
    base = F.regexp_replace(filename, EXTENSION, "")
    base = F.regexp_replace(F.regexp_replace(base, DATE_STAMP, ""), VERSION_TAG, "")
    return _snake(base)


def raw_base(filename: Column) -> Column:
    """File name without its last extension, in snake case."""
    return _snake(F.regexp_replace(filename, r"\.[^.]+$", ""))


def _usable(base: Column) -> Column:
    return (F.length(base) >= MIN_LENGTH) & (base != PLACEHOLDER_TABLE)


def suggestions_from_filename(files: DataFrame) -> DataFrame:
    """``file_id, priority, name`` suggested by the file name: base and its plural."""
    files, base = spread(files).select("file_id", clean_base(F.col("filename")).alias("base")), F.col("base")
    plural = ~base.endswith("s") & ~base.endswith("data")
    names = F.when(_usable(base), F.when(plural, F.array(base, F.concat(base, F.lit("s")))).otherwise(F.array(base)))
    return files.select("file_id", F.posexplode_outer(names).alias("priority", "name")).filter("name IS NOT NULL")


def suggestions_from_ids(columns: DataFrame) -> DataFrame:
    """``file_id, ordinal, name`` suggested by identifier columns."""
    key = F.col("key")
    known = F.create_map(*[F.lit(x) for pair in ID_TABLES.items() for x in pair])
    entity = F.left(key, F.length(key) - 3)
    derived = F.when(key.endswith("_id") & (F.length(entity) >= MIN_LENGTH), F.concat(entity, F.lit("s")))
    keyed = spread(columns).select("file_id", "ordinal", web_name(F.col("name")).alias("key"))
    name = F.coalesce(F.try_element_at(known, key), derived)
    return each(keyed, F.array(name), "name", "file_id", "ordinal").groupBy("file_id", "name").agg(
        F.min("ordinal").alias("ordinal"))


def suggestions_from_domains(columns: DataFrame) -> DataFrame:
    """``file_id, priority, name`` suggested by clusters of column-name fragments."""
    fragments = sorted({f for groups, _ in DOMAIN_RULES for g in groups for f in g})
    keyed = spread(columns).select("file_id", web_name(F.col("name")).alias("key"))
    flags = keyed.groupBy("file_id").agg(*[F.bool_or(F.col("key").contains(f)).alias(f"has_{f}") for f in fragments])
    hits, priority = [], 0
    for groups, names in DOMAIN_RULES:
        fires = reduce(lambda a, b: a | b, [
            reduce(lambda a, b: a & b, [F.col(f"has_{f}") for f in group]) for group in groups])
        for name in names:
            hits.append(F.when(fires, F.struct(F.lit(priority).alias("priority"), F.lit(name).alias("name"))))
            priority += 1
    return each(flags, F.array(*hits), "hit", "file_id").select("file_id", "hit.*")


def suggest_names(files: DataFrame, columns: DataFrame) -> DataFrame:
    """At most five suggestions per file, in order; a fixed trio when none apply.

    Every source contributes rows with a sort position; the first position of a name
    counts. The trio takes part as the last step and is dropped where anything precedes it.
    """
    def step(df: DataFrame, number: int, position: str) -> DataFrame:
        # One number for (step, position) keeps the aggregate hash-based.
        return df.select("file_id", "name", (F.lit(number * STEP) + F.col(position)).alias("place"))

    bases = spread(files).select("file_id", raw_base(F.col("filename")).alias("base"))
    base = F.col("base")
    whole = each(bases, F.array(F.when(_usable(base), base)), "name", "file_id", F.lit(0).alias("priority"))
    trio = files.select("file_id", F.posexplode(F.array(*[F.lit(n) for n in FALLBACK_NAMES])).alias("priority", "name"))
    found = (
        step(suggestions_from_filename(files), 1, "priority")
        .unionByName(step(suggestions_from_ids(columns), 2, "ordinal"))
        .unionByName(step(suggestions_from_domains(columns), 3, "priority"))
        .unionByName(step(whole, 4, "priority"))
        .filter((F.length("name") >= MIN_LENGTH) & ~F.col("name").isin(*REJECTED_NAMES))
        .unionByName(step(trio, FALLBACK_STEP, "priority"))
    )
    first = found.groupBy("file_id", "name").agg(F.min("place").alias("place"))
    per_file = Window.partitionBy("file_id")
    order = per_file.orderBy("place", "name")
    top = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MAX_SUGGESTIONS)
    real = F.col("place") < FALLBACK_STEP * STEP
    none_real = F.min("place").over(per_file) >= FALLBACK_STEP * STEP
    return top.withColumn("keep", real | none_real).filter("keep").select("file_id", "rank", "name")
