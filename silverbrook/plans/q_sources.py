"""Queries over the raw file readers and storage discovery."""

import uuid
from functools import reduce

from pyspark.sql import functions as F

from silverbrook.functions import naming
from silverbrook.operators import export
from silverbrook.plans import feeds
from silverbrook.plans.registry import Tables, query
from silverbrook.session import materialize, scratch_path
from silverbrook.sources import readers, storage

CSV_OPTIONS = {"header": True, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "escape": '"'}


def messy_orders(t: Tables):
    """The orders table under headers as people type them."""
    return t.orders.toDF(*[feeds.ORDER_HEADERS[c] for c in t.orders.columns])


def dropped(df, t: Tables, label: str, fmt: str, **options) -> str:
    """Write a DataFrame as raw files into fresh scratch space."""
    path = scratch_path(t.spark, label)
    df.write.format(fmt).options(**options).save(path)
    return path


@query("src_csv", feeds.ORDERS_CLEAN_SQL)
def src_csv(t: Tables):
    return readers.read_csv(t.spark, dropped(messy_orders(t), t, "csv", "csv", **CSV_OPTIONS))


def block_bytes(size: int, most: int) -> int:
    """So that a small file has many blocks, and a large one not many more: 128 KiB, or a hundredth of the largest file, up to ``most``."""
    return min(most, max(128 * 1024, size // 100))


@query("src_csv_split", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total_price,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || chr(10) || '"' || o_orderpriority || '",' || chr(10)
            ELSE o_orderpriority END AS note FROM {orders}""")
def src_csv_split(t: Tables):
    """Files with line breaks and quotes inside quoted cells, each read by many tasks; one file if the orders are one partition."""
    broken = F.concat("o_orderstatus", F.lit('\n"'), "o_orderpriority", F.lit('",\n'))
    rows = t.orders.select(
        F.col("o_orderkey").alias("Order ID"), F.col("o_custkey").alias("Customer ID"), F.col("o_totalprice").alias("Total Price"),
        F.when(F.col("o_orderkey") % 3 == 0, broken).otherwise(F.col("o_orderpriority")).alias("Note"))
    path = dropped(rows, t, "split", "csv", ignoreTrailingWhiteSpace=False, **CSV_OPTIONS)
    most = t.spark.conf.get("spark.sql.files.maxPartitionBytes")
    limit = int(t.spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    t.spark.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes(storage.stored_bytes(t.spark, path), limit)))
    try:
        return materialize(readers.read_csv(t.spark, path), "split-rows")
    finally:
        t.spark.conf.set("spark.sql.files.maxPartitionBytes", most)


@query("src_parquet", feeds.ORDERS_CLEAN_SQL)
def src_parquet(t: Tables):
    return readers.read_parquet(t.spark, dropped(messy_orders(t), t, "parquet", "parquet"))


NDJSON_SQL = """
SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day, date_trunc('second', ts) AS at,
       CAST(json_extract(props, '$.k') AS BIGINT) AS props_k
FROM {events}"""


def _json_events(t: Tables):
    return t.events.select(
        F.col("event_id").alias("Event ID"), F.col("user_id").alias("User-ID"),
        F.col("event_type").alias("event type"), "value",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("At"),
        F.from_json("props", "k bigint").alias("Props"))


def _flat(df):
    return df.withColumn("props_k", F.col("props.k")).drop("props")


@query("src_ndjson", NDJSON_SQL)
def src_ndjson(t: Tables):
    return _flat(readers.read_json(t.spark, dropped(_json_events(t), t, "ndjson", "json")))


@query("src_json_array", NDJSON_SQL)
def src_json_array(t: Tables):
    path = export.export_json_array(_json_events(t), scratch_path(t.spark, "json-array"))
    return _flat(readers.read_json(t.spark, path))


@query("src_dispatch", """
SELECT 'csv' AS fmt, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM {events} GROUP BY event_type
UNION ALL SELECT 'parquet', event_type, count(*), CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)
FROM {events} GROUP BY event_type
UNION ALL SELECT 'json', event_type, count(*), CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)
FROM {events} GROUP BY event_type""")
def src_dispatch(t: Tables):
    """The same events in three formats, read back through the format dispatch."""
    rows = t.events.select("event_type", "value")
    parts = []
    for fmt, options in (("csv", {"header": True}), ("parquet", {}), ("json", {})):
        df = readers.read_any(t.spark, dropped(rows, t, "dispatch", fmt, **options), declared=fmt)
        parts.append(df.groupBy("event_type").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"),
        ).select(F.lit(fmt).alias("fmt"), "event_type", "n", "total"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("src_union_by_name", """
SELECT o_orderkey, o_custkey, CAST(NULL AS DOUBLE) AS o_totalprice FROM {orders} WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM {orders} WHERE o_orderstatus <> 'F'""")
def src_union_by_name(t: Tables):
    root = scratch_path(t.spark, "union")
    t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey").write.parquet(f"{root}/a")
    t.orders.filter("o_orderstatus <> 'F'").select("o_totalprice", "o_orderkey").write.parquet(f"{root}/b")
    return readers.read_union_by_name(t.spark, [f"{root}/a", f"{root}/b"])


@query("src_union_conflicts", """
SELECT o_orderkey AS id, CAST(o_custkey AS DOUBLE) AS amount, CAST(CAST(o_custkey AS INTEGER) AS STRING) AS mark,
       CAST(o_orderdate AS TIMESTAMP) AS at, NULL AS extra FROM {orders} WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_totalprice, o_orderpriority, CAST(o_orderdate AS TIMESTAMP), NULL FROM {orders} WHERE o_orderstatus = 'O'
UNION ALL SELECT CAST(o_orderkey AS INTEGER), NULL, NULL, CAST(o_orderdate AS DATE), o_orderstatus FROM {orders} WHERE o_orderstatus = 'P'""")
def src_union_conflicts(t: Tables):
    """Files that disagree on types: int and long, long and double, number and text, date and timestamp."""
    root = scratch_path(t.spark, "union")
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    t.orders.filter("o_orderstatus = 'F'").select(
        key.cast("long").alias("id"), F.col("o_custkey").cast("long").alias("amount"),
        F.col("o_custkey").cast("int").alias("mark"), day.cast("timestamp_ntz").alias("at")).write.parquet(f"{root}/a")
    t.orders.filter("o_orderstatus = 'O'").select(
        F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("mark"), day.cast("timestamp_ntz").alias("at"),
        key.cast("long").alias("id")).write.parquet(f"{root}/b")
    t.orders.filter("o_orderstatus = 'P'").select(
        key.cast("int").alias("id"), day.cast("date").alias("at"), F.col("o_orderstatus").alias("extra")).write.parquet(f"{root}/c")
    return readers.read_union_by_name(t.spark, root)


@query("src_path_table", """
SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus""")
def src_path_table(t: Tables):
    from silverbrook.plans.tenant_query import TenantGuard, tenant_sql

    root = scratch_path(t.spark, "lake")
    path = f"{root}/tenants/tenant_acme/tables/orders"
    t.orders.write.parquet(path)
    guard = TenantGuard(t.spark, ["tenant_acme"], file_root=root)
    sql = f"SELECT o_orderstatus, count(*) AS n FROM parquet.`{path}` GROUP BY o_orderstatus"
    return tenant_sql(t.spark, guard, "tenant_acme", sql).full


@query("src_discover", """
SELECT CASE o_orderstatus WHEN 'F' THEN 'tenant_a' ELSE 'tenant_b' END AS tenant_id,
       CASE o_orderstatus WHEN 'P' THEN 'gold' ELSE 'silver' END AS layer, 'orders' AS table_name, count(*) AS n_rows
FROM {orders} GROUP BY ALL""")
def src_discover(t: Tables):
    """Tables written below a storage root, found by listing it and counted via their views."""
    root, tag = scratch_path(t.spark, "store"), uuid.uuid4().hex[:10]
    for status, place in (("F", "a/tables"), ("O", "b/tables"), ("P", "b/gold")):
        t.orders.filter(F.col("o_orderstatus") == status).write.parquet(f"{root}/tenants/tenant_{tag}{place}/orders")
    found = storage.tables_in(storage.list_files(t.spark, root))
    counts = []
    for name in storage.register_tables(t.spark, root, found):
        schema, table = name.split(".")
        tenant, layer = schema.removeprefix(f"tenant_{tag}").split("_")
        counts.append(t.spark.table(name).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(f"tenant_{tenant}").alias("tenant_id"), F.lit(layer).alias("layer"),
            F.lit(table).alias("table_name"), "n_rows"))
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("src_tables_in", f"""
WITH f AS ({feeds.FILES})
SELECT split_part(path, '/', 2) AS tenant_id,
       CASE split_part(path, '/', 3) WHEN 'tables' THEN 'silver' ELSE 'gold' END AS layer,
       split_part(path, '/', 4) AS table_name, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS n_bytes
FROM f WHERE path LIKE '%.parquet' AND split_part(path, '/', 3) IN ('tables', 'gold') GROUP BY 1, 2, 3""")
def src_tables_in(t: Tables):
    return storage.tables_in(t.sql(feeds.FILES))


@query("src_tenants", f"""
SELECT DISTINCT split_part(path, '/', 2) AS tenant_id FROM ({feeds.FILES}) AS f ORDER BY 1""")
def src_tenants(t: Tables):
    return storage.tenants_in(t.sql(feeds.FILES))


# names -----------------------------------------------------------------------------

@query("prj_clean_columns", feeds.ORDERS_CLEAN_SQL)
def prj_clean_columns(t: Tables):
    return naming.clean_columns(messy_orders(t))


@query("prj_clean_names", r"""
SELECT doc_id, lower(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g')) AS clean
FROM {documents}
UNION ALL SELECT -1 - page_id,
  lower(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g')) FROM {pages}""")
def prj_clean_names(t: Tables):
    """Column cleaning over whole document texts and page addresses."""
    names = t.documents.select("doc_id", F.col("text").alias("raw")).unionAll(
        t.pages.select(-1 - F.col("page_id"), "url"))
    return names.select("doc_id", naming.clean_column(F.col("raw")).alias("clean"))


@query("prj_web_names", """
SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') AS web
FROM {documents}""")
def prj_web_names(t: Tables):
    return t.documents.select("doc_id", naming.web_name(F.col("text")).alias("web"))


@query("prj_table_names", """
WITH r AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ' ' || p_name WHEN 1 THEN 'Dataset' WHEN 2 THEN '__'
             WHEN 3 THEN '#' || p_brand || '!' ELSE substr(p_type, 1, 1) END AS requested FROM {part}),
     c AS (SELECT *, regexp_replace(regexp_replace(lower(trim(requested)), '[^a-z0-9_]', '_', 'g'),
                     '^_+|_+$', '', 'g') AS cleaned FROM r)
SELECT p_partkey, requested, cleaned AS ingest_name,
       lower(trim(requested)) NOT IN ('', 'dataset') AND length(cleaned) >= 2 AS is_valid,
       lower(regexp_replace(trim(requested), '[^a-zA-Z0-9_]', '_', 'g')) AS gold_name
FROM c""")
def prj_table_names(t: Tables):
    asked = t.part.select("p_partkey", F.expr("""
        CASE p_size % 5 WHEN 0 THEN ' ' || p_name WHEN 1 THEN 'Dataset' WHEN 2 THEN '__'
             WHEN 3 THEN '#' || p_brand || '!' ELSE substr(p_type, 1, 1) END""").alias("requested"))
    name = F.col("requested")
    return asked.select("p_partkey", "requested", naming.ingest_table_name(name).alias("ingest_name"),
                        naming.is_valid_table_name(name).alias("is_valid"),
                        naming.gold_object_name(name).alias("gold_name"))


@query("prj_tenant_slugs", """
WITH r AS (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' || c_name || ' '
             WHEN 2 THEN 'tenant_' || c_mktsegment ELSE '##' END AS slug, c_mktsegment || '-co ' || c_name AS name
           FROM {customer}),
     g AS (SELECT *, regexp_replace(regexp_replace(lower(trim(coalesce(slug, ''))), '[^a-z0-9_-]+', '_', 'g'),
                     '^_+|_+$', '', 'g') AS given FROM r),
     s AS (SELECT c_custkey, CASE WHEN given = '' THEN 'tenant_'
             || regexp_replace(lower(trim(name)), '[^a-z0-9_-]+', '_', 'g')
             WHEN given LIKE 'tenant!_%' ESCAPE '!' THEN given ELSE 'tenant_' || given END AS tenant_slug FROM g)
SELECT c_custkey, tenant_slug, array_to_string(list_transform(
         regexp_extract_all(replace(tenant_slug, '_', ' '), '[a-z0-9]+[^a-z0-9]*'),
         lambda w: upper(w[1]) || w[2:]), '') AS friendly_name
FROM s""")
def prj_tenant_slugs(t: Tables):
    asked = t.customer.select("c_custkey", F.expr("""
        CASE c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' || c_name || ' '
             WHEN 2 THEN 'tenant_' || c_mktsegment ELSE '##' END""").alias("slug"),
        F.concat("c_mktsegment", F.lit("-co "), "c_name").alias("name"))
    slugs = asked.select("c_custkey", naming.tenant_slug(F.col("slug"), F.col("name")).alias("tenant_slug"))
    return slugs.withColumn("friendly_name", naming.friendly_tenant_name(F.col("tenant_slug")))
