"""Registry, log and catalog inputs derived from the driver tables.

Each text runs unchanged in Spark SQL and in the checking engine, so both sides of a
comparison start from the same rows. Every feed reads whole tables and grows with them.
"""

from silverbrook.session import together

# Dataset registry: one dataset per order, owned by the customer's tenant.
DATASETS = """
SELECT o_orderkey AS dataset_id,
       'tenant_' || CAST(o_custkey AS STRING) AS tenant_id,
       replace(lower(o_orderpriority), ' ', '_') || '_' || CAST(o_orderkey AS STRING) AS name,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'gold' ELSE 'silver' END AS layer,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
       CAST(floor(o_totalprice) AS BIGINT) AS row_count,
       CASE WHEN o_orderpriority = '5-LOW' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE CAST(NULL AS BIGINT) END
         AS duration_ms,
       o_orderdate AS created_at,
       o_orderdate + INTERVAL '1' SECOND * CAST(floor(o_totalprice / 1000) AS INT) AS updated_at
FROM {orders}"""

# Tenant registry: one tenant per customer.
TENANTS = """
SELECT 'tenant_' || CAST(c_custkey AS STRING) AS slug,
       c_name AS name,
       c_acctbal >= 0 AS active,
       CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'inactive' END AS status,
       CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS deactivated_at,
       CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-01 00:00:00'
            + INTERVAL '1' DAY * CAST(-floor(c_acctbal / 50) AS INT) END AS deletion_scheduled_at
FROM {customer}"""

# Users: one per customer, with every role and some without a tenant.
USERS = """
SELECT 'u' || CAST(c_custkey AS STRING) AS user_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'platform_admin' WHEN 'MACHINERY' THEN 'tenant_admin'
            ELSE 'tenant_user' END AS role,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN CAST(NULL AS STRING)
            ELSE 'tenant_' || CAST(c_nationkey AS STRING) END AS tenant
FROM {customer}"""

# Worker jobs: one per order line; returned lines carry no tenant.
JOBS = """
SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS job_id,
       l_orderkey AS dataset_id,
       CASE WHEN l_returnflag = 'R' THEN CAST(NULL AS STRING)
            ELSE 'tenant_' || CAST(l_suppkey AS STRING) END AS tenant_id,
       l_shipdate AS created_at
FROM {lineitem}"""

# Dataset status log.
JOB_EVENTS = """
SELECT user_id AS dataset_id, ts AS happened_at, event_id AS seq,
       CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'completed'
            WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
       CAST(floor(value) AS BIGINT) AS row_count
FROM {events}"""

# Names of stored files, one per order.
FILES = """
SELECT 'tenants/tenant_' || CAST(o_custkey AS STRING) || CASE o_orderstatus
         WHEN 'F' THEN '/tables/t' || substr(o_orderpriority, 1, 1) || '/part-' || CAST(o_orderkey AS STRING)
              || CASE WHEN o_totalprice > 250000 THEN '.parquet' ELSE '.crc' END
         WHEN 'O' THEN '/raw/' || CAST(o_orderkey AS STRING) || '_orders.csv'
         ELSE '/gold/g' || substr(o_orderpriority, 1, 1) || '/part-' || CAST(o_orderkey AS STRING) || '.parquet'
       END AS path,
       CAST(floor(o_totalprice) AS BIGINT) AS length
FROM {orders}"""

# Catalog with validity columns.
CATALOG_SCHEMAS = """
SELECT c_custkey AS schema_id, 'tenant_' || CAST(c_custkey AS STRING) || '_silver' AS schema_name,
       CASE WHEN c_acctbal < 0 THEN 7 END AS end_snapshot
FROM {customer}"""

CATALOG_TABLES = """
SELECT o_orderkey AS table_id, o_custkey AS schema_id, 't_' || CAST(o_orderkey AS STRING) AS table_name,
       CASE WHEN o_orderstatus = 'P' THEN 9 END AS end_snapshot
FROM {orders}"""

# Raw catalog listing with repeats, aliases and system schemas.
LISTING = """
SELECT event_id AS ordinal,
       CASE event_type WHEN 'view' THEN 'tenant_' || CAST(user_id AS STRING) || '_silver'
            WHEN 'click' THEN 'tenant_' || CAST(user_id AS STRING) || '_gold'
            WHEN 'error' THEN 'pg_catalog' ELSE 'main' END AS table_schema,
       CASE WHEN event_type IN ('view', 'click') THEN 't_' || CAST(CAST(floor(value) AS BIGINT) AS STRING)
            WHEN value < 1 THEN 'temp_clean_source'
            ELSE 'tenant_' || CAST(user_id AS STRING) || '_t' || CAST(CAST(floor(value / 10) AS BIGINT) AS STRING)
            END AS table_name,
       CASE WHEN value > 10 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type
FROM {events}"""

# Gold definitions with dependencies spelled in all the ways users spell them.
GOLD_OBJECTS = """
SELECT 'tenant_' || CAST(o_custkey AS STRING) AS tenant_id,
       'gold_' || CAST(o_orderkey AS STRING) AS name,
       CASE WHEN o_orderstatus = 'F' THEN 'table' ELSE 'view' END AS object_type,
       'SELECT a.id FROM tenant_' || CAST(o_custkey AS STRING) || '_silver.src_' || lower(o_orderstatus)
         || ' a join tenant_' || CAST(o_custkey AS STRING) || '_dim_' || substr(o_orderpriority, 1, 1)
         || ' b ON a.id = b.id LEFT JOIN gold_' || CAST(o_orderkey AS STRING) || ' c ON TRUE JOIN'
         || chr(10) || 'Tenant_' || CAST(o_custkey AS STRING) || '_gold.gold_' || CAST(o_orderkey - 1 AS STRING)
         || ' d ON TRUE WHERE a.xfrom > 1' AS sql_query
FROM {orders}"""

# Columns of datasets: finished orders are tables, open ones incoming files, the rest Gold.
DATASET_COLUMNS = """
SELECT DISTINCT 'tenant_' || CAST(o_custkey AS STRING) AS tenant_id, o_orderkey AS dataset_id,
       l_linenumber * 100000000 + l_partkey AS ordinal,
       CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '_')
            ELSE '_' || replace(p_name, ' ', '-') END AS name,
       CASE p_size % 9 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'DOUBLE' WHEN 2 THEN 'VARCHAR' WHEN 3 THEN 'TIMESTAMP'
            WHEN 4 THEN 'BOOLEAN' WHEN 5 THEN 'DECIMAL(18,2)' WHEN 6 THEN 'integer' WHEN 7 THEN 'text'
            ELSE 'STRUCT(a INTERVAL)' END AS type,
       CASE o_orderstatus WHEN 'F' THEN 'silver' WHEN 'O' THEN 'file' ELSE 'gold' END AS layer
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON p_partkey = l_partkey"""


def dataset_columns(t):
    """Rows of ``DATASET_COLUMNS``, each dataset's brought together before repeats are dropped.

    Hardly any repeat, so a task holds what it reads in its table of distinct rows.
    """
    rows = t.sql(DATASET_COLUMNS.replace("SELECT DISTINCT", "SELECT", 1))
    return together(rows, t.lineitem.count(), "dataset_id").distinct()


# Names of uploaded files, one per order, and the columns found in them.
UPLOAD_FILES = """
SELECT o_orderkey AS file_id,
       CASE o_orderpriority
         WHEN '1-URGENT' THEN 'Order Export ' || substr(CAST(o_orderdate AS STRING), 1, 10) || '.csv'
         WHEN '2-HIGH' THEN 'sales_v' || CAST(o_custkey AS STRING) || '.final.parquet'
         WHEN '3-MEDIUM' THEN 'dataset.json'
         WHEN '4-NOT SPECIFIED' THEN 'x' || CAST(o_orderkey AS STRING) || '_raw-backup.TXT'
         ELSE 'data.csv' END AS filename
FROM {orders}"""

UPLOAD_COLUMNS = """
SELECT l_orderkey AS file_id, l_linenumber * 100000000 + l_partkey AS ordinal,
       CASE l_partkey % 12 WHEN 0 THEN 'Customer_ID' WHEN 1 THEN 'widget_id' WHEN 2 THEN 'ab_id'
            WHEN 3 THEN 'unit price' WHEN 4 THEN 'quantity' WHEN 5 THEN 'Exam-Score' WHEN 6 THEN 'Longitude'
            WHEN 7 THEN 'plan_tier' WHEN 8 THEN 'salary' WHEN 9 THEN 'log_id' WHEN 10 THEN 'payload'
            ELSE 'note' END AS name
FROM {lineitem}"""

# Log of submitted statements: allowed ones, every kind of refusal, and free text.
QUERY_LOG = """
SELECT event_id AS query_id, 'tenant_' || CAST(user_id AS STRING) AS tenant_id,
  CASE event_id % 20
    WHEN 0 THEN 'SELECT * FROM ' || t || '_silver.' || event_type
    WHEN 1 THEN 'SELECT a.x FROM ' || t || '_gold.' || event_type || ' a JOIN ' || t || '_sales b ON a.id = b.id;'
    WHEN 2 THEN 'SELECT * FROM tenant_' || CAST(user_id + 1 AS STRING) || '_' || event_type
    WHEN 3 THEN 'SELECT * FROM Tenant_b.customers WHERE v > ' || CAST(user_id AS STRING)
    WHEN 4 THEN 'DROP TABLE ' || t || '_' || event_type
    WHEN 5 THEN 'SELECT 1; DELETE FROM ' || event_type
    WHEN 6 THEN 'SELECT 1; SELECT 2'
    WHEN 7 THEN 'SELECT * FROM DuckLake_Catalog.tables'
    WHEN 8 THEN 'SELECT * FROM read_parquet(''s3://b/tenants/tenant_x/' || event_type || '.parquet'')'
    WHEN 9 THEN 'SELECT * FROM read_csv(''tenants/' || t || '/raw/' || event_type || '.csv'')'
    WHEN 10 THEN '  ' || chr(10)
    WHEN 11 THEN 'SELECT extract(year FROM o.d) FROM ' || t || '_' || event_type || ' o'
    WHEN 12 THEN 'SELECT * FROM "' || t || '_silver"."' || event_type || '"'
    WHEN 13 THEN 'select x from/**/tenant_b_' || event_type
    WHEN 14 THEN 'SELECT FROM ' || t || '_' || event_type || ' WHERE ((a = '')'' '
    WHEN 15 THEN 'SELECT a, FROM ' || event_type || ') WHERE (b = 1)'
    WHEN 16 THEN 'SELECT '' update '' AS s FROM ' || t || '_' || event_type
    WHEN 17 THEN 'SELECT * FROM ' || event_type || ', tenant_b_silver.c'
    WHEN 18 THEN 'SELECT ''it''''s'' AS q, ''open FROM ' || t || '_' || event_type || ' ORDER BY 1, LIMIT 3'
    ELSE 'SELECT a' || chr(10) || 'FROM' || chr(10) || t || '_silver.' || event_type || chr(10) || 'GROUP BY a' END
    AS sql
FROM (SELECT *, 'tenant_' || CAST(user_id AS STRING) AS t FROM {events}) AS e
UNION ALL
SELECT -1 - doc_id AS query_id, 'tenant_' || source AS tenant_id, text AS sql FROM {documents}"""

# JSON records with mixed, null and absent values.
JSON_RECORDS = """
SELECT event_type,
  '{"id":' || CAST(event_id AS STRING) || ',"user":"u' || CAST(user_id AS STRING) || '","value":'
  || CAST(value AS STRING) || ',"whole":' || CAST(user_id AS STRING) || '.0,"ok":'
  || CASE WHEN value > 5 THEN 'true' ELSE 'false' END
  || ',"at":"' || substr(CAST(ts AS STRING), 1, 19) || '","key":"0f8fad5b-d9cb-' || event_type
  || '","tags":["a"],"props":' || props
  || ',"maybe":' || CASE WHEN value > 9 THEN 'null' ELSE '1' END
  || ',"mixed":' || CASE WHEN value > 9 THEN '"x"' ELSE '2' END
  || CASE WHEN user_id > 50 THEN ',"extra":1.5' ELSE '' END || '}' AS doc
FROM {events}"""

# Messy headers used when tables are written out as raw files.
ORDER_HEADERS = {
    "o_orderkey": "Order ID (#)", "o_custkey": " Customer--ID ", "o_orderstatus": "STATUS",
    "o_totalprice": "Total Price €", "o_orderdate": "Ordered @", "o_orderpriority": "Priority/Level",
}
ORDER_CLEAN = {
    "o_orderkey": "order_id", "o_custkey": "customer_id", "o_orderstatus": "status",
    "o_totalprice": "total_price", "o_orderdate": "ordered", "o_orderpriority": "priority_level",
}
ORDERS_CLEAN_SQL = "SELECT " + ", ".join(f"{k} AS {v}" for k, v in ORDER_CLEAN.items()) + " FROM {orders}"
