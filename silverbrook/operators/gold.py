"""Gold objects: stored views and materialised query results.

Every object's definition is kept below the lake's registry, so that views can be rebuilt
in a new session and a source is not dropped while something still reads it.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverbrook.functions import sqltext
from silverbrook.operators import lineage
from silverbrook.operators.tables import Lake
from silverbrook.plans.tenant_query import QueryRefused, TenantGuard
from silverbrook.session import materialize as intermediate
from silverbrook.sources.storage import delete_folder, path_exists, safe_name


@dataclass(frozen=True)
class GoldObject:
    name: str
    full_name: str
    object_type: str
    columns: list[str] = field(default_factory=list)
    row_count: int | None = None


def gold_name(requested: str) -> str:
    """Cleaned object name (same rule as ``functions.naming.gold_object_name``)."""
    return re.sub(r"[^a-zA-Z0-9_]", "_", requested.strip()).lower()


DEFINITION_SCHEMA = "tenant_id string, name string, object_type string, sql_query string"


def _define(lake: Lake, tenant: str, name: str, object_type: str, sql: str) -> None:
    row = lake.spark.createDataFrame([(tenant, name, object_type, sql)], DEFINITION_SCHEMA)
    row.coalesce(1).write.mode("overwrite").json(f"{lake.root}/registry/gold/{safe_name(tenant)}/{name}")


def definitions(lake: Lake) -> DataFrame:
    """All Gold definitions with the objects they read."""
    folder = f"{lake.root}/registry/gold"
    if not path_exists(lake.spark, folder):
        stored = lake.spark.createDataFrame([], DEFINITION_SCHEMA)
    else:
        stored = lake.spark.read.schema(DEFINITION_SCHEMA).option("recursiveFileLookup", True).json(folder)
    return stored.withColumn(
        "dependencies", sqltext.dependencies(F.col("sql_query"), F.col("tenant_id"), F.col("name")))


def view_levels(objects: DataFrame) -> Iterator[DataFrame]:
    """Views (tenant_id, name, sql_query), a DataFrame per level, each level reading none of the later ones.

    A level is what no longer reads a waiting view: an anti-join of the views that wait with the edges between them.
    What is left when none is ready reads itself in a circle, and comes as a last level under ``circular``.
    """
    views = intermediate(objects.filter("object_type = 'view'").select("tenant_id", "name", "sql_query"), "views")
    known = views.select("tenant_id", F.col("name").alias("dependency"))
    edges = lineage.dependency_edges(views).where("dependency <> name").join(known, ["tenant_id", "dependency"])
    edges = intermediate(edges, "view-edges")
    waiting = views
    while not waiting.isEmpty():
        held = edges.join(waiting.select("tenant_id", F.col("name").alias("dependency")), ["tenant_id", "dependency"])
        held = held.select("tenant_id", "name", F.lit(True).alias("held")).distinct()
        marked = intermediate(waiting.join(held, ["tenant_id", "name"], "left"), "view-level")
        ready = marked.where("held IS NULL").drop("held")
        if ready.isEmpty():
            yield waiting.withColumn("circular", F.lit(True))
            return
        yield ready.withColumn("circular", F.lit(False))
        waiting = marked.where("held").drop("held")


def restore_views(lake: Lake, tenant: str | None = None, guard: TenantGuard | None = None) -> list[str]:
    """Rebuild stored views in the session, level by level, each through the guard; returns their names.

    A view that the guard refuses, whose source is gone or that reads itself in a circle is left out with a warning.
    """
    objects = definitions(lake)
    if guard is None:
        tenants = objects.select("tenant_id").union(lake.commits().select("tenant_id")).distinct()
        guard = TenantGuard(lake.spark, [r.tenant_id for r in tenants.toLocalIterator()])
    if tenant is not None:
        objects = objects.filter(F.col("tenant_id") == tenant)
    done, left = [], []
    for level in view_levels(objects):
        for v in level.orderBy("tenant_id", "name").toLocalIterator():
            full_name = f"{v.tenant_id}_gold.{v.name}"
            try:
                if v.circular:
                    raise QueryRefused("the view reads itself in a circle", 400)
                guard.plan(v.tenant_id, v.sql_query)
                schema = f"{safe_name(v.tenant_id)}_gold"
                lake.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
                lake.spark.sql(f"CREATE OR REPLACE VIEW `{schema}`.`{safe_name(v.name)}` AS {v.sql_query}")
                done.append(full_name)
            except (AnalysisException, QueryRefused, ValueError) as error:
                left.append(f"{full_name}: {str(error).splitlines()[0]}")
    if left:
        warnings.warn(f"views not restored: {left}", stacklevel=2)
    return done


def drop(lake: Lake, tenant: str, name: str, layer: str = "silver", object_type: str = "table",
         force: bool = False) -> bool:
    """Drop an object unless another one reads it; ``force`` drops it anyway."""
    others = definitions(lake).filter(~((F.col("name") == name) & (F.lit(layer) == "gold")))
    lineage.check_deletable(others, tenant, name, layer, force)
    went = lake.drop(tenant, name, layer, object_type)
    if layer == "gold":
        delete_folder(lake.spark, f"{lake.root}/registry/gold/{safe_name(tenant)}/{safe_name(name)}")
    return went


def create_view(lake: Lake, guard: TenantGuard, tenant: str, name: str, sql: str) -> GoldObject:
    """Create or replace a view that is computed anew on every read."""
    text, name = sql.strip().rstrip(";"), safe_name(gold_name(name))
    guard.plan(tenant, text)
    schema = f"{safe_name(tenant)}_gold"
    lake.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
    lake.spark.sql(f"CREATE OR REPLACE VIEW `{schema}`.`{name}` AS {text}")
    _define(lake, tenant, name, "view", text)
    return GoldObject(name, f"{schema}.{name}", "view", lake.spark.table(f"`{schema}`.`{name}`").columns)


def materialize(lake: Lake, guard: TenantGuard, tenant: str, name: str, sql: str,
                append: bool = False, batch_id: str | None = None) -> GoldObject:
    """Store a query result. A second run replaces the table unless ``append`` is set."""
    text, name = sql.strip().rstrip(";"), safe_name(gold_name(name))
    done = lake.commit(tenant, name, guard.plan(tenant, text), layer="gold", batch_id=batch_id, replace=not append)
    _define(lake, tenant, name, "table", text)
    return GoldObject(name, done.table, "table", done.columns, done.total_rows)
