"""Ingestion job reports over the dataset registry and its append-only event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverbrook.operators.ordered import previous_value

# Feed sizes.
FEED_LIMIT = 20
DATASET_LIMIT = 50

# Allowed status moves; the first event of a dataset has no predecessor.
TRANSITIONS = {
    "pending": ("uploaded",),
    "uploaded": ("processing", "failed"),
    "processing": ("completed", "failed"),
    "completed": ("uploaded", "processing"),
    "failed": ("uploaded", "processing"),
}


def job_feed(datasets: DataFrame, tenants: DataFrame, tenant: str, limit: int = FEED_LIMIT) -> DataFrame:
    """Newest datasets of one registered tenant; an unknown tenant gets nothing."""
    known = tenants.filter(F.col("slug") == tenant).select(F.col("slug").alias("tenant_id"))
    mine = datasets.filter(F.col("tenant_id") == tenant).join(known, "tenant_id", "left_semi")
    return mine.orderBy(F.desc("created_at"), F.desc("dataset_id")).limit(limit)


def scoped_jobs(jobs: DataFrame, datasets: DataFrame, tenant: str, limit: int | None = FEED_LIMIT) -> DataFrame:
    """Jobs tagged with the tenant or, when untagged, working on one of its datasets.

    The either-or is two disjoint branches, each with an equality, instead of one OR join.
    """
    tagged = jobs.filter(F.col("tenant_id") == tenant)
    own = datasets.filter(F.col("tenant_id") == tenant).select("dataset_id")
    untagged = jobs.filter(F.col("tenant_id").isNull()).join(own, "dataset_id", "left_semi")
    both = tagged.unionByName(untagged.select(*jobs.columns))
    if limit is None:
        return both
    return both.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def search_jobs(datasets: DataFrame, status: str | None = None, text: str | None = None) -> DataFrame:
    """Status equality and case-insensitive name search."""
    if status and status != "all":
        datasets = datasets.filter(F.col("status") == status)
    if text:
        datasets = datasets.filter(F.lower("name").contains(text.lower()))
    return datasets


def search_tables(tables: DataFrame, text: str) -> DataFrame:
    """Tables whose short or full name contains the text."""
    wanted = text.lower()
    return tables.filter(F.lower("name").contains(wanted) | F.lower("full_name").contains(wanted))


def _millis(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", earlier, later)


def with_duration(datasets: DataFrame, now: Column) -> DataFrame:
    """Job duration in milliseconds: stored, else from the timestamps, else null."""
    spent = _millis(F.col("updated_at"), F.col("created_at"))
    elapsed = F.greatest(F.lit(100).cast("bigint"), _millis(now, F.col("created_at")))
    return datasets.withColumn("duration", F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
                               .when(F.col("status").isin("completed", "failed") & (spent > 100), spent)
                               .when(F.col("status") == "processing", elapsed))


def latest_status(events: DataFrame, key: str = "dataset_id", order: tuple[str, ...] = ("happened_at", "seq")) -> DataFrame:
    """Current state of every dataset: its last event, picked while aggregating."""
    rest = [c for c in events.columns if c != key and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("last")
    return events.groupBy(key).agg(last, F.count(F.lit(1)).alias("n_events")).select(key, "last.*", "n_events")


def illegal_transitions(events: DataFrame, chunk: Column, key: str = "dataset_id",
                        order: tuple[str, ...] = ("happened_at", "seq")) -> DataFrame:
    """Events whose status may not follow the one before it."""
    allowed = F.create_map(*[
        x for old, new in TRANSITIONS.items() for x in (F.lit(old), F.array(*[F.lit(n) for n in new]))
    ])
    with_previous = previous_value(events, [key], list(order), "status", chunk, "previous_status")
    nexts = F.coalesce(F.try_element_at(allowed, F.col("previous_status")), F.array().cast("array<string>"))
    return with_previous.filter(
        F.col("previous_status").isNotNull() & ~F.array_contains(nexts, F.col("status")))
