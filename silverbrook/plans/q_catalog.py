"""Queries over the registry, the job log and the access policy."""

from pyspark.sql import functions as F

from silverbrook.operators import access, catalog, jobs
from silverbrook.plans import feeds
from silverbrook.plans.q_sinks import Scene
from silverbrook.plans.registry import Tables, query
from silverbrook.sources import storage

NOW = "TIMESTAMP '2002-01-01 00:00:00'"


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def tenants(t: Tables):
    """Tenant registry with zone-free lifecycle times."""
    rows = t.sql(feeds.TENANTS)
    return rows.withColumns({
        c: F.col(c).cast("timestamp_ntz") for c in ("deactivated_at", "deletion_scheduled_at")})


@query("cat_live_tables", f"""
SELECT t.table_id, s.schema_name, t.table_name FROM ({feeds.CATALOG_TABLES}) AS t
JOIN ({feeds.CATALOG_SCHEMAS}) AS s ON t.schema_id = s.schema_id
WHERE t.end_snapshot IS NULL AND s.end_snapshot IS NULL""")
def cat_live_tables(t: Tables):
    return catalog.live_tables(t.sql(feeds.CATALOG_TABLES), t.sql(feeds.CATALOG_SCHEMAS))


@query("cat_list_tables", f"""
WITH l AS (SELECT *, CASE WHEN table_schema = 'main' THEN table_name ELSE table_schema || '.' || table_name END
             AS full_name FROM ({feeds.LISTING}) AS x
           WHERE table_name NOT IN ('temp_clean_source', '_committer_source')
             AND table_schema NOT IN ('information_schema', 'pg_catalog', 'temp'))
SELECT full_name, table_name AS name, table_schema AS schema,
       CASE WHEN table_schema LIKE '%!_gold%' ESCAPE '!' THEN 'gold' ELSE 'silver' END AS layer,
       CASE WHEN upper(table_type) LIKE '%VIEW%' THEN 'view' ELSE 'table' END AS type
FROM l QUALIFY row_number() OVER (PARTITION BY full_name ORDER BY ordinal) = 1""")
def cat_list_tables(t: Tables):
    return catalog.list_tables(t.sql(feeds.LISTING))


@query("cat_list_tenant_tables", f"""
WITH l AS (SELECT *, CASE WHEN table_schema = 'main' THEN table_name ELSE table_schema || '.' || table_name END
             AS full_name FROM ({feeds.LISTING}) AS x
           WHERE table_name NOT IN ('temp_clean_source', '_committer_source')
             AND (table_schema IN ('tenant_7_silver', 'tenant_7_gold')
                  OR (table_schema = 'main' AND starts_with(table_name, 'tenant_7_'))))
SELECT full_name, CASE WHEN table_schema = 'main' THEN substr(table_name, 10) ELSE table_name END AS name,
       table_schema AS schema, CASE WHEN table_schema = 'tenant_7_gold' THEN 'gold' ELSE 'silver' END AS layer,
       CASE WHEN upper(table_type) LIKE '%VIEW%' THEN 'view' ELSE 'table' END AS type
FROM l QUALIFY row_number() OVER (PARTITION BY full_name ORDER BY ordinal) = 1""")
def cat_list_tenant_tables(t: Tables):
    return catalog.list_tables(t.sql(feeds.LISTING), "tenant_7")


@query("cat_columns", f"""
SELECT tenant_id, dataset_id, count(*) AS n_columns, min(ordinal) AS first_ordinal, arg_min(name, ordinal) AS first_name,
       count(DISTINCT type) AS n_types
FROM ({feeds.DATASET_COLUMNS}) AS c GROUP BY 1, 2""")
def cat_columns(t: Tables):
    """Column summary per dataset from exploded column rows."""
    return feeds.dataset_columns(t).groupBy("tenant_id", "dataset_id").agg(
        F.count(F.lit(1)).alias("n_columns"), F.min("ordinal").alias("first_ordinal"),
        F.min_by("name", "ordinal").alias("first_name"), F.count_distinct("type").alias("n_types"))


def _committed(t: Tables) -> Scene:
    """Two tenants with tables committed from the given data, one of them in two batches that differ."""
    scene = Scene(t)
    slim = t.orders.select("o_orderkey", "o_custkey")
    scene.commit(slim.where("o_custkey % 2 = 0"), "orders", mode="evolve")
    scene.commit(t.orders.where("o_custkey % 2 = 1"), "orders", mode="evolve")
    scene.commit(t.customer, "customer", tenant=scene.globex)
    scene.commit(t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")), "per_nation", layer="gold")
    return scene


def _place(scene: Scene, name):
    """A catalog name without the random part of the scene's tenants."""
    return F.regexp_replace(F.regexp_replace(name, scene.acme, "acme"), scene.globex, "globex")


_SQL_TYPE = """CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  ELSE lower(data_type) END"""


@query("cat_table_columns", f"""
WITH c AS (SELECT table_name, column_name, ordinal_position AS i, {_SQL_TYPE} AS type FROM information_schema.columns
           WHERE table_schema = 'main' AND table_name IN ('orders', 'customer')),
o AS (SELECT *, row_number() OVER (ORDER BY CASE column_name WHEN 'o_orderkey' THEN -2 WHEN 'o_custkey' THEN -1 ELSE i END)
        AS ordinal FROM c WHERE table_name = 'orders')
SELECT 'acme_silver.orders' AS full_name, CAST(ordinal AS INTEGER) AS ordinal, column_name AS name, type,
       (SELECT count(*) FROM {{orders}}) AS n_rows FROM o
UNION ALL SELECT 'globex_silver.customer', CAST(i AS INTEGER), column_name, type, (SELECT count(*) FROM {{customer}})
FROM c WHERE table_name = 'customer'
UNION ALL SELECT 'acme_gold.per_nation', 1, 'c_nationkey', max(type), (SELECT count(DISTINCT c_nationkey) FROM {{customer}})
FROM c WHERE column_name = 'c_nationkey'
UNION ALL SELECT 'acme_gold.per_nation', 2, 'n', 'bigint', count(DISTINCT c_nationkey) FROM {{customer}}""")
def cat_table_columns(t: Tables):
    """Columns of every committed table, read from the commit log as a DataFrame."""
    scene = _committed(t)
    log = scene.lake.commits()
    sizes = log.groupBy(F.concat("tenant_id", F.lit("_"), "layer", F.lit("."), "table_name").alias("full_name")).agg(
        F.sum("row_count").alias("n_rows"))
    found = catalog.logged_columns(log).join(sizes, "full_name")
    return found.withColumn("full_name", _place(scene, "full_name"))


@query("cat_session_tables", """
SELECT * FROM (VALUES ('acme_silver.orders', 'orders', 'acme_silver', 'silver', 'view'),
  ('acme_orders', 'acme_orders', 'main', 'silver', 'view'), ('globex_silver.customer', 'customer', 'globex_silver', 'silver', 'view'),
  ('globex_customer', 'globex_customer', 'main', 'silver', 'view'), ('acme_gold.per_nation', 'per_nation', 'acme_gold', 'gold', 'view')
) AS v(full_name, name, schema, layer, type) WHERE (SELECT count(*) FROM {orders}) > 0""")
def cat_session_tables(t: Tables):
    """Listing of all committed tables and aliases from the commit log, without asking the session table by table."""
    scene = _committed(t)
    found = catalog.list_tables(catalog.logged_objects(scene.lake.commits()))
    return found.select(*[_place(scene, c).alias(c) for c in ("full_name", "name", "schema")], "layer", "type")


@query("cat_dataset_counts", f"""
SELECT t.slug, t.name, count(d.dataset_id) AS dataset_count FROM ({feeds.TENANTS}) AS t
LEFT JOIN ({feeds.DATASETS}) AS d ON d.tenant_id = t.slug GROUP BY 1, 2""")
def cat_dataset_counts(t: Tables):
    return catalog.dataset_counts(tenants(t), t.sql(feeds.DATASETS), pinned="tenant_7")


@query("cat_new_tenants", f"""
SELECT DISTINCT d.slug, 'Tenant ' || substr(d.slug, 8) AS name, TRUE AS active, 'active' AS status
FROM (SELECT split_part(path, '/', 2) AS slug FROM ({feeds.FILES}) AS f) AS d
WHERE d.slug NOT IN (SELECT slug FROM ({feeds.TENANTS}) AS t WHERE active)""")
def cat_new_tenants(t: Tables):
    found = storage.tenants_in(t.sql(feeds.FILES))
    return catalog.unregistered_tenants(found, tenants(t).filter("active"))


@query("cat_job_feed", f"""
SELECT d.* FROM ({feeds.DATASETS}) AS d WHERE tenant_id = 'tenant_7'
AND 'tenant_7' IN (SELECT slug FROM ({feeds.TENANTS}) AS t) ORDER BY created_at DESC, dataset_id DESC LIMIT 20""")
def cat_job_feed(t: Tables):
    return jobs.job_feed(t.sql(feeds.DATASETS), tenants(t), "tenant_7")


@query("cat_job_feed_unknown", f"SELECT d.* FROM ({feeds.DATASETS}) AS d WHERE FALSE")
def cat_job_feed_unknown(t: Tables):
    """A tenant the registry does not know gets no rows, although datasets name it."""
    return jobs.job_feed(t.sql(feeds.DATASETS), tenants(t).filter("slug <> 'tenant_7'"), "tenant_7")


@query("cat_scoped_jobs", f"""
SELECT j.* FROM ({feeds.JOBS}) AS j WHERE tenant_id = 'tenant_7' OR (tenant_id IS NULL AND dataset_id IN
  (SELECT dataset_id FROM ({feeds.DATASETS}) AS d WHERE d.tenant_id = 'tenant_7'))""")
def cat_scoped_jobs(t: Tables):
    return jobs.scoped_jobs(t.sql(feeds.JOBS), t.sql(feeds.DATASETS), "tenant_7", limit=None)


@query("cat_job_search", f"""
SELECT dataset_id, name, status FROM ({feeds.DATASETS}) AS d WHERE status = 'failed' AND name LIKE '%medium%'""")
def cat_job_search(t: Tables):
    return jobs.search_jobs(t.sql(feeds.DATASETS), "failed", "MEDIUM").select("dataset_id", "name", "status")


@query("cat_job_duration", f"""
SELECT dataset_id, status, CASE WHEN duration_ms > 0 THEN duration_ms
  WHEN status IN ('completed', 'failed') AND epoch_ms(updated_at) - epoch_ms(created_at) > 100
    THEN epoch_ms(updated_at) - epoch_ms(created_at)
  WHEN status = 'processing' THEN greatest(100, epoch_ms({NOW}) - epoch_ms(created_at)) END AS duration
FROM ({feeds.DATASETS}) AS d""")
def cat_job_duration(t: Tables):
    return jobs.with_duration(t.sql(feeds.DATASETS), F.expr(NOW).cast("timestamp_ntz")).select(
        "dataset_id", "status", "duration")


@query("cat_latest_status", f"""
SELECT dataset_id, happened_at, seq, status, row_count, count(*) OVER (PARTITION BY dataset_id) AS n_events
FROM ({feeds.JOB_EVENTS}) AS e QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY happened_at DESC, seq DESC) = 1""")
def cat_latest_status(t: Tables):
    return jobs.latest_status(t.sql(feeds.JOB_EVENTS))


@query("cat_illegal_transitions", f"""
WITH p AS (SELECT *, lag(status) OVER (PARTITION BY dataset_id ORDER BY happened_at, seq) AS previous_status
           FROM ({feeds.JOB_EVENTS}) AS e)
SELECT dataset_id, happened_at, seq, status, row_count, previous_status FROM p
WHERE previous_status IS NOT NULL AND NOT (
  (previous_status = 'pending' AND status = 'uploaded')
  OR (previous_status = 'uploaded' AND status IN ('processing', 'failed'))
  OR (previous_status = 'processing' AND status IN ('completed', 'failed'))
  OR (previous_status IN ('completed', 'failed') AND status IN ('uploaded', 'processing')))""")
def cat_illegal_transitions(t: Tables):
    return jobs.illegal_transitions(t.sql(feeds.JOB_EVENTS), F.date_trunc("day", "happened_at"))


@query("cat_upsert", f"""
WITH r AS (SELECT tenant_id, status AS name, layer, dataset_id AS version, row_count, created_at
           FROM ({feeds.DATASETS}) AS d)
SELECT tenant_id, name, layer, max(version) AS version, arg_max(row_count, version) AS row_count,
       min(created_at) AS created_at FROM r GROUP BY 1, 2, 3""")
def cat_upsert(t: Tables):
    """Replays every dataset row as an upsert of (tenant, status, layer)."""
    rows = t.sql(feeds.DATASETS).select(
        "tenant_id", F.col("status").alias("name"), "layer", F.col("dataset_id").alias("version"), "row_count",
        "created_at")
    return catalog.upsert_gold(rows.filter("layer = 'gold'"), rows.filter("layer <> 'gold'"))


@query("cat_gold_union", f"""
WITH g AS (SELECT tenant_id, name, layer, tenant_id || '_gold.' || name AS full_name,
             CASE WHEN status = 'completed' THEN 'table' ELSE 'view' END AS object_type, status
           FROM ({feeds.DATASETS}) AS d WHERE layer = 'gold')
SELECT tenant_id, name, full_name, object_type,
       CASE WHEN status = 'completed' THEN 'registry' ELSE 'catalog' END AS origin FROM g""")
def cat_gold_union(t: Tables):
    objects = t.sql(feeds.DATASETS).select(
        "tenant_id", "name", "layer", F.concat("tenant_id", F.lit("_gold."), "name").alias("full_name"),
        F.when(F.col("status") == "completed", "table").otherwise("view").alias("object_type"), "status")
    registered = objects.filter("layer = 'gold' AND status = 'completed'")
    return catalog.merge_gold(registered, objects)


@query("cat_lifecycle_due", f"""
SELECT slug, deletion_scheduled_at FROM ({feeds.TENANTS}) AS t
WHERE status = 'inactive' AND deletion_scheduled_at <= TIMESTAMP '2024-01-10 00:00:00'""")
def cat_lifecycle_due(t: Tables):
    return catalog.due_for_deletion(tenants(t), _ts("2024-01-10")).select("slug", "deletion_scheduled_at")


@query("cat_lifecycle_apply", f"""
WITH r AS (SELECT 'tenant_' || CAST(c_custkey AS STRING) AS slug,
             CASE c_mktsegment WHEN 'BUILDING' THEN 'deactivate' ELSE 'reactivate' END AS action,
             CASE WHEN c_nationkey > 10 THEN c_nationkey END AS grace_days FROM {{customer}})
SELECT t.slug, CASE action WHEN 'deactivate' THEN FALSE WHEN 'reactivate' THEN TRUE ELSE active END AS active,
  CASE action WHEN 'deactivate' THEN 'inactive' WHEN 'reactivate' THEN 'active' ELSE status END AS status,
  CASE WHEN action = 'deactivate' THEN {NOW} WHEN action IS NULL THEN deactivated_at END AS deactivated_at,
  CASE WHEN action = 'deactivate' THEN {NOW} + to_days(CAST(coalesce(grace_days, 14) AS INT))
       WHEN action IS NULL THEN deletion_scheduled_at END AS deletion_scheduled_at
FROM ({feeds.TENANTS}) AS t LEFT JOIN r ON r.slug = t.slug""")
def cat_lifecycle_apply(t: Tables):
    requests = t.customer.select(
        F.concat(F.lit("tenant_"), "c_custkey").alias("slug"),
        F.when(F.col("c_mktsegment") == "BUILDING", "deactivate").otherwise("reactivate").alias("action"),
        F.when(F.col("c_nationkey") > 10, F.col("c_nationkey")).alias("grace_days"))
    return catalog.deactivate(tenants(t), requests, _ts("2002-01-01"))


@query("cat_access_filter", f"""
SELECT 'member' AS caller, dataset_id FROM ({feeds.DATASETS}) AS d WHERE tenant_id = 'tenant_7'
UNION ALL SELECT 'admin', dataset_id FROM ({feeds.DATASETS}) AS d""")
def cat_access_filter(t: Tables):
    rows = t.sql(feeds.DATASETS)
    callers = {
        "member": access.Caller("u1", "tenant_user", "tenant_7"), "admin": access.Caller("u2", access.ADMIN),
        "loner": access.Caller("u3", "tenant_user"), "nobody": None,
    }
    parts = [
        access.visible_datasets(rows, caller).select(F.lit(label).alias("caller"), "dataset_id")
        for label, caller in callers.items()
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("cat_access_users", f"""
SELECT 'tenant_admin' AS caller, user_id FROM ({feeds.USERS}) AS u WHERE tenant = 'tenant_7'
UNION ALL SELECT 'self', user_id FROM ({feeds.USERS}) AS u WHERE user_id = 'u9'""")
def cat_access_users(t: Tables):
    users = t.sql(feeds.USERS)
    mine = access.visible_users(users, access.Caller("u1", access.TENANT_ADMIN, "tenant_7"))
    me = access.visible_users(users, access.Caller("u9", "tenant_user", "tenant_7"))
    return mine.select(F.lit("tenant_admin").alias("caller"), "user_id").unionAll(me.select(F.lit("self"), "user_id"))


@query("cat_access_counts", f"""
WITH d AS (SELECT tenant_id, count(*) AS n FROM ({feeds.DATASETS}) AS x GROUP BY 1)
SELECT u.user_id, u.role, u.tenant, CASE WHEN u.role = 'platform_admin' THEN (SELECT count(*) FROM {{orders}})
       ELSE coalesce(d.n, 0) END AS visible_rows
FROM ({feeds.USERS}) AS u LEFT JOIN d ON d.tenant_id = u.tenant""")
def cat_access_counts(t: Tables):
    return access.visible_counts(t.sql(feeds.USERS), t.sql(feeds.DATASETS))
