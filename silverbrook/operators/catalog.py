"""Catalog and registry reports: tables, columns, tenants and Gold objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the tenant listed first.
PINNED_TENANT = "tenant_acme"

# Working relations that never show in listings.
HIDDEN_TABLES = ("temp_clean_source", "_committer_source")
HIDDEN_SCHEMAS = ("information_schema", "pg_catalog", "temp")

# Fixed value: days between deactivation and deletion.
GRACE_DAYS = 14


def live_tables(tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """Tables whose own and whose schema's validity is open."""
    open_tables = tables.filter(F.col("end_snapshot").isNull()).select("table_id", "schema_id", "table_name")
    open_schemas = schemas.filter(F.col("end_snapshot").isNull()).select("schema_id", "schema_name")
    return open_tables.join(open_schemas, "schema_id").select("table_id", "schema_name", "table_name")


def list_tables(objects: DataFrame, tenant: str | None = None) -> DataFrame:
    """Classified table listing, one row per full name.

    ``objects`` has ``ordinal, table_schema, table_name, table_type``. The row with the
    smallest ordinal wins; the choice is an aggregate, so it combines before the shuffle.
    """
    schema, name = F.col("table_schema"), F.col("table_name")
    rows = objects.filter(~name.isin(*HIDDEN_TABLES) & ~schema.isin(*HIDDEN_SCHEMAS))
    is_alias = schema == "main"
    if tenant is not None:
        flat = name.startswith(f"{tenant}_")
        rows = rows.filter(schema.isin(f"{tenant}_silver", f"{tenant}_gold") | (is_alias & flat))
        display = F.when(is_alias & flat, F.substr(name, F.lit(len(tenant) + 2))).otherwise(name)
    else:
        display = name
    gold = schema.contains("_gold") & ~schema.contains("_silver")
    listed = rows.select(
        F.when(is_alias, name).otherwise(F.concat_ws(".", schema, name)).alias("full_name"),
        F.struct(
            "ordinal",
            display.alias("name"),
            schema.alias("schema"),
            F.when(gold, "gold").otherwise("silver").alias("layer"),
            F.when(F.upper(F.coalesce("table_type", F.lit(""))).contains("VIEW"), "view")
            .otherwise("table").alias("type"),
        ).alias("entry"),
    )
    first = listed.groupBy("full_name").agg(F.min("entry").alias("entry"))
    return first.select("full_name", "entry.name", "entry.schema", "entry.layer", "entry.type")


def session_objects(spark: SparkSession) -> DataFrame:
    """Tables and views of the session's schemas in the shape ``list_tables`` reads."""
    rows = []
    for db in spark.catalog.listDatabases():
        for t in spark.catalog.listTables(db.name):
            if not t.isTemporary and not t.name.endswith(("__batches", "__files")):
                schema = "main" if db.name == "default" else db.name
                rows.append((len(rows), schema, t.name, t.tableType or ""))
    return spark.createDataFrame(rows, "ordinal bigint, table_schema string, table_name string, table_type string")


def table_columns(spark: SparkSession, full_names) -> DataFrame:
    """One row per column of the named tables, from catalog metadata."""
    rows = [
        (name, i, f.name, f.dataType.simpleString())
        for name in full_names for i, f in enumerate(spark.table(name).schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, "full_name string, ordinal int, name string, type string")


# Names of types in a stored schema that SQL spells otherwise.
_SQL_TYPES = {"long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint"}


def _latest(commits: DataFrame) -> DataFrame:
    """One row per committed table with the schema of its last commit."""
    return commits.groupBy("tenant_id", "layer", "table_name").agg(F.max_by("table_schema", "snapshot_id").alias("stored"))


def logged_columns(commits: DataFrame) -> DataFrame:
    """One row per column of every committed table, from the schemas in the commit log."""
    fields = F.from_json("stored", "fields array<struct<name string, type string>>")["fields"]
    rows = _latest(commits).select(
        F.concat("tenant_id", F.lit("_"), "layer", F.lit("."), "table_name").alias("full_name"),
        F.posexplode(fields).alias("at", "field"))
    names = F.create_map(*[F.lit(x) for pair in _SQL_TYPES.items() for x in pair])
    return rows.select("full_name", (F.col("at") + 1).alias("ordinal"), F.col("field.name").alias("name"),
                       F.coalesce(names[F.col("field.type")], F.col("field.type")).alias("type"))


def logged_objects(commits: DataFrame) -> DataFrame:
    """Every committed table and its flat alias in the shape ``list_tables`` reads, from the commit log."""
    tables = _latest(commits)
    schema = F.concat("tenant_id", F.lit("_"), "layer")
    alias = F.struct(F.lit(1).cast("long").alias("ordinal"), F.lit("main").alias("table_schema"),
                     F.concat("tenant_id", F.lit("_"), "table_name").alias("table_name"))
    own = F.struct(F.lit(0).cast("long").alias("ordinal"), schema.alias("table_schema"), F.col("table_name"))
    both = F.when(F.col("layer") == "silver", F.array(own, alias)).otherwise(F.array(own))
    return tables.select(F.explode(both).alias("o")).select("o.*", F.lit("VIEW").alias("table_type"))


def dataset_counts(tenants: DataFrame, datasets: DataFrame, pinned: str = PINNED_TENANT) -> DataFrame:
    """Datasets per tenant, zero included; the pinned tenant first, then by name.

    Counting happens before the join, so one busy tenant is one row there.
    """
    counts = datasets.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
    joined = tenants.join(counts, tenants["slug"] == counts["tenant_id"], "left")
    return joined.select("slug", "name", F.coalesce("n", F.lit(0)).alias("dataset_count")).orderBy(
        F.col("slug") != pinned, "name", "slug")


def unregistered_tenants(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Tenants present in storage and absent from the registry, as new registry rows."""
    from silverbrook.functions.naming import friendly_tenant_name

    new = found.select(F.col("tenant_id").alias("slug")).distinct().join(registry, "slug", "left_anti")
    return new.select("slug", friendly_tenant_name(F.col("slug")).alias("name"),
                      F.lit(True).alias("active"), F.lit("active").alias("status"))


def upsert_gold(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registry after an upsert by (tenant_id, name, layer).

    Both sides carry ``version``; for a key the highest version wins, and the created
    time of the first one stays. One aggregate with map-side combining replaces a merge.
    """
    keys = ["tenant_id", "name", "layer"]
    rows = current.unionByName(incoming)
    rest = [c for c in rows.columns if c not in keys + ["version", "created_at"]]
    newest = F.max(F.struct("version", *rest)).alias("newest")
    return rows.groupBy(*keys).agg(newest, F.min("created_at").alias("created_at")).select(
        *keys, "newest.*", "created_at")


def merge_gold(registered: DataFrame, catalog: DataFrame) -> DataFrame:
    """Registered Gold objects plus catalog tables the registry does not know by name."""
    extra = catalog.filter(F.col("layer") == "gold").join(registered, ["tenant_id", "name"], "left_anti")
    columns = ["tenant_id", "name", "full_name", "object_type"]
    return registered.select(*columns, F.lit("registry").alias("origin")).unionByName(
        extra.select(*columns, F.lit("catalog").alias("origin")))


def deactivate(tenants: DataFrame, requests: DataFrame, at) -> DataFrame:
    """Apply lifecycle requests (``slug, action, grace_days``) to the tenant registry.

    ``deactivate`` schedules deletion after the grace days, ``reactivate`` clears it.
    """
    joined = tenants.join(requests, "slug", "left")
    off, on = F.col("action") == "deactivate", F.col("action") == "reactivate"
    due = F.timestamp_add("DAY", F.coalesce("grace_days", F.lit(GRACE_DAYS)), at)
    return joined.select(
        "slug",
        F.when(off, False).when(on, True).otherwise(F.col("active")).alias("active"),
        F.when(off, "inactive").when(on, "active").otherwise(F.col("status")).alias("status"),
        F.when(off, at).when(on, F.lit(None)).otherwise(F.col("deactivated_at")).alias("deactivated_at"),
        F.when(off, due).when(on, F.lit(None)).otherwise(F.col("deletion_scheduled_at"))
        .alias("deletion_scheduled_at"),
    )


def due_for_deletion(tenants: DataFrame, as_of) -> DataFrame:
    """Inactive tenants whose grace period has run out."""
    return tenants.filter((F.col("status") == "inactive") & (F.col("deletion_scheduled_at") <= as_of))
