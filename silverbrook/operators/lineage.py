"""Dependencies between Gold definitions and the objects they read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverbrook.functions import sqltext
from silverbrook.session import each, spread


def dependency_edges(objects: DataFrame) -> DataFrame:
    """One row per (tenant_id, name, dependency) from ``tenant_id, name, sql_query``."""
    deps = sqltext.dependencies(F.col("sql_query"), F.col("tenant_id"), F.col("name"))
    return each(spread(objects), deps, "dependency", "tenant_id", "name").distinct()


def dependents(objects: DataFrame, sources: DataFrame) -> DataFrame:
    """Gold objects that read each source: equi-join of exploded references.

    ``objects`` has ``tenant_id, name, object_type, dependencies``; ``sources`` has
    ``tenant_id, name``. A reference may be bare, flat-prefixed or Silver-qualified.
    """
    refs = each(spread(objects), F.col("dependencies"), "ref",
                "tenant_id", F.col("name").alias("dependent"), "object_type")
    silver = F.concat(F.col("tenant_id"), F.lit("_silver."))
    flat = F.concat(F.col("tenant_id"), F.lit("_"))
    # Every spelling of a reference becomes the bare name it could stand for.
    spellings = F.array(
        F.col("ref"),
        F.when(F.startswith("ref", silver), F.substr("ref", F.length(silver) + 1)),
        F.when(F.startswith("ref", flat), F.substr("ref", F.length(flat) + 1)),
    )
    refs = each(refs, spellings, "name", "tenant_id", "dependent", "object_type").distinct()
    return refs.join(sources.select("tenant_id", "name").distinct(), ["tenant_id", "name"])


def dependents_of(objects: DataFrame, tenant: str, name: str, substring: bool = False) -> DataFrame:
    """Gold objects of one tenant that depend on ``name``.

    ``substring`` also counts any definition whose text contains the name, which
    over-reports but misses nothing.
    """
    wanted = F.array(F.lit(name), F.lit(f"{tenant}_silver.{name}"), F.lit(f"{tenant}_{name}"))
    hit = F.arrays_overlap(F.coalesce("dependencies", F.array().cast("array<string>")), wanted)
    if substring:
        hit = hit | F.lower(F.coalesce("sql_query", F.lit(""))).contains(name.lower())
    return objects.filter((F.col("tenant_id") == tenant) & hit)


class DependentsError(Exception):
    """Deletion refused because other objects read the target."""


def check_deletable(objects: DataFrame, tenant: str, name: str, layer: str = "silver",
                    force: bool = False) -> list[str]:
    """Names of dependents; raises unless there are none or ``force`` is set."""
    found = dependents_of(objects, tenant, name, substring=True)
    names = [f"{r.name} ({r.object_type or 'view'})" for r in found.select("name", "object_type").toLocalIterator()]
    if names and not force:
        raise DependentsError(f"cannot delete {layer} object '{name}', used by: {', '.join(names)}")
    return names


def missing_sources(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Objects with at least one dependency that no current table satisfies.

    A dependency is satisfied by a table's short name (tenant prefixes stripped) or by
    its full name, ignoring case: two anti-joins, each on an equality.
    """
    edges = edges.select("tenant_id", "name", F.lower("dependency").alias("full"), F.lower("dependency").alias("short"))
    for suffix in ("_silver.", "_gold.", "_"):
        prefix = F.concat(F.lower("tenant_id"), F.lit(suffix))
        edges = edges.withColumn("short", sqltext.without_first(F.col("short"), prefix))
    short = catalog.select("tenant_id", F.lower("name").alias("short")).distinct()
    full = catalog.select("tenant_id", F.lower("full_name").alias("full")).distinct()
    unmet = edges.join(short, ["tenant_id", "short"], "left_anti").join(full, ["tenant_id", "full"], "left_anti")
    return unmet.groupBy("tenant_id", "name").agg(F.count(F.lit(1)).alias("n_missing"))
