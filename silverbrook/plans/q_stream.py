"""Queries that drive the ingestion stream over whole tables."""

from pyspark.sql import functions as F

from silverbrook.operators.tables import Lake
from silverbrook.plans import feeds
from silverbrook.plans.q_sinks import Scene
from silverbrook.plans.q_sources import CSV_OPTIONS, messy_orders
from silverbrook.plans.registry import Tables, query
from silverbrook.session import scratch_path
from silverbrook.streaming import ingest

def upload(t: Tables, lake: Lake, tenant: str, name: str, df, fmt: str = "csv") -> tuple:
    ingest.land(df, lake, tenant, name, fmt, **(CSV_OPTIONS if fmt == "csv" else {}))
    return (f"tenants/{tenant}/raw/{name}", tenant, "orders", fmt)


def registry(t: Tables, rows: list[tuple]):
    return t.spark.createDataFrame(rows, "raw_file_path string, tenant_id string, table_name string, format string")


@query("str_ingest", """
SELECT CASE o_orderstatus WHEN 'F' THEN 'tenant_acme' ELSE 'tenant_globex' END AS tenant_id,
       o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total_price, o_orderdate AS ordered
FROM {orders} WHERE o_orderstatus IN ('F', 'O')
UNION ALL SELECT 'tenant_acme', o_orderkey, o_custkey, o_totalprice, o_orderdate FROM {orders} WHERE o_orderstatus = 'P'
""")
def str_ingest(t: Tables):
    """Two tenants' uploads, then a third file for the first: every row arrives once."""
    scene, checkpoint = Scene(t), scratch_path(t.spark, "ingest")
    lake, rows = scene.lake, messy_orders(t)
    uploads = [
        upload(t, lake, scene.acme, "1000_F.csv", rows.filter("STATUS = 'F'")),
        upload(t, lake, scene.globex, "1000_O.csv", rows.filter("STATUS = 'O'")),
    ]
    ingest.start_ingest(lake, lambda: registry(t, uploads), checkpoint).awaitTermination()
    uploads.append(upload(t, lake, scene.acme, "2000_P.csv", rows.filter("STATUS = 'P'")))
    for _ in range(2):
        ingest.start_ingest(lake, lambda: registry(t, uploads), checkpoint).awaitTermination()
    parts = [
        lake.read(tenant, "orders").select(F.lit(label).alias("tenant_id"), "order_id", "customer_id", "total_price",
                                           "ordered")
        for tenant, label in ((scene.acme, "tenant_acme"), (scene.globex, "tenant_globex"))
    ]
    return parts[0].unionByName(parts[1])


@query("str_quarantine", """
SELECT 'completed' AS status, count(*) AS row_count FROM {orders} WHERE o_orderstatus <> 'O'
UNION ALL SELECT 'failed', 0 FROM {orders} HAVING count(*) > 0
UNION ALL SELECT 'visible', count(*) FROM {orders} WHERE o_orderstatus <> 'O'
UNION ALL SELECT 'quarantined', count(*) FROM {orders} WHERE o_orderstatus = 'O'""")
def str_quarantine(t: Tables):
    """A file whose prices are words fails whole; the good file next to it goes through."""
    scene, checkpoint = Scene(t), scratch_path(t.spark, "ingest")
    lake, rows = scene.lake, messy_orders(t)
    price = feeds.ORDER_HEADERS["o_totalprice"]
    good = upload(t, lake, scene.acme, "1000_F.csv", rows.filter("STATUS <> 'O'"))
    ingest.start_ingest(lake, lambda: registry(t, [good]), checkpoint).awaitTermination()
    bad = upload(t, lake, scene.acme, "2000_O.csv", rows.filter("STATUS = 'O'").withColumn(price, F.lit("lots")))
    ingest.start_ingest(lake, lambda: registry(t, [good, bad]), checkpoint).awaitTermination()
    outcome = ingest.job_events(lake).groupBy("status").agg(F.sum("row_count").alias("row_count"))
    visible = lake.read(scene.acme, "orders").agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("visible").alias("status"), "row_count")
    held = ingest.quarantined(lake, scene.acme, "orders").agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("quarantined").alias("status"), "row_count")
    return outcome.unionByName(visible).unionByName(held)


def _arrivals(t: Tables, parts: list[tuple], fmt: str, mode: str = "by_name", late: bool = False):
    """The orders table of a fresh lake after each part was dropped and ingested in turn.

    With ``late`` a file is registered only after a first run has seen it.
    """
    scene, checkpoint, uploads = Scene(t), scratch_path(t.spark, "ingest"), []
    for n, df in enumerate(parts):
        known = list(uploads)
        uploads.append(upload(t, scene.lake, scene.acme, f"{n}.{fmt}", df, fmt))
        for rows in (known, uploads) if late else (uploads,):
            ingest.start_ingest(scene.lake, lambda rows=rows: registry(t, rows), checkpoint, mode).awaitTermination()
    return scene.lake.read(scene.acme, "orders")


def _halves(t: Tables):
    rows = messy_orders(t)
    return rows.filter("STATUS = 'F'"), rows.filter("STATUS <> 'F'")


@query("str_reordered", feeds.ORDERS_CLEAN_SQL)
def str_reordered(t: Tables):
    """The second file has the same columns in another order; values go by name."""
    first, second = _halves(t)
    return _arrivals(t, [first, second.select(*[F.col(f"`{c}`") for c in reversed(second.columns)])], "csv")


@query("str_ingest_json", feeds.ORDERS_CLEAN_SQL)
def str_ingest_json(t: Tables):
    """Two JSON files whose keys need cleaning; the second meets an existing table."""
    spelled = [df.withColumn(feeds.ORDER_HEADERS["o_orderdate"], F.date_format(
        f"`{feeds.ORDER_HEADERS['o_orderdate']}`", "yyyy-MM-dd'T'HH:mm:ss")) for df in _halves(t)]
    return _arrivals(t, spelled, "json").select(*feeds.ORDER_CLEAN.values())


@query("str_late_registration", feeds.ORDERS_CLEAN_SQL)
def str_late_registration(t: Tables):
    """Files are seen before their registry rows exist, and arrive once these do."""
    return _arrivals(t, list(_halves(t)), "csv", late=True)


@query("str_evolve", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status,
       CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS total_price,
       CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS priority_level FROM {orders}""")
def str_evolve(t: Tables):
    """The second file lacks a column and brings a new one."""
    first, second = _halves(t)
    names = feeds.ORDER_HEADERS
    common = [F.col(f"`{names[c]}`") for c in ("o_orderkey", "o_custkey", "o_orderstatus")]
    return _arrivals(t, [first.select(*common, F.col(f"`{names['o_totalprice']}`")),
                         second.select(*common, F.col(f"`{names['o_orderpriority']}`"))], "csv", "evolve")


def _one_batch(t: Tables, parts: list[tuple], mode: str):
    """The orders table after all parts, (name, rows, format), arrived in one batch."""
    scene = Scene(t)
    uploads = [upload(t, scene.lake, scene.acme, name, df, fmt) for name, df, fmt in parts]
    ingest.start_ingest(scene.lake, lambda: registry(t, uploads), scratch_path(t.spark, "ingest"), mode).awaitTermination()
    return scene.lake


@query("str_ingest_parquet", """
SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS customer_id,
       CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS total_price,
       CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS priority_level FROM {orders}""")
def str_ingest_parquet(t: Tables):
    """Parquet files of three sets of columns and two key types in one batch: no column is lost."""
    rows, names = messy_orders(t), feeds.ORDER_HEADERS
    key, who, price, level = (names[c] for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"))
    parts = []
    for status, columns in (("F", (key, who, price)), ("O", (who, level, key)), ("P", (key, level))):
        some = rows.filter(F.col("STATUS") == status).select(*[F.col(f"`{c}`") for c in columns])
        parts.append((status, some.withColumn(key, F.col(f"`{key}`").cast("int")) if status == "O" else some, "parquet"))
    scene = _one_batch(t, parts, "evolve")
    tenant = scene.commits().first().tenant_id
    return scene.read(tenant, "orders").select("order_id", "customer_id", "total_price", "priority_level")


@query("str_mixed_shapes", """
SELECT 'completed' AS status, count(*) AS row_count FROM {orders} WHERE o_orderstatus <> 'O'
UNION ALL SELECT 'failed', 0 UNION ALL SELECT 'visible', count(*) FROM {orders} WHERE o_orderstatus <> 'O'""")
def str_mixed_shapes(t: Tables):
    """In strict mode the file with a column too many fails, though it shares its batch and format with good ones."""
    rows, key = messy_orders(t), feeds.ORDER_HEADERS["o_orderkey"]
    slim = rows.select(F.col(f"`{key}`"), "STATUS")
    parts = [("1", slim.filter("STATUS = 'F'"), "parquet"), ("2", rows.filter("STATUS = 'O'"), "parquet"),
             ("3", slim.filter("STATUS = 'P'").select("STATUS", F.col(f"`{key}`")), "json")]
    lake = _one_batch(t, parts, "by_name")
    outcome = ingest.job_events(lake).groupBy("status").agg(F.sum("row_count").alias("row_count"))
    return outcome.unionByName(lake.commits().agg(F.sum("row_count").alias("row_count")).select(
        F.lit("visible").alias("status"), "row_count"))


@query("str_pending_many", feeds.ORDERS_CLEAN_SQL)
def str_pending_many(t: Tables):
    """Files wait for their registry row and then arrive a few at a time."""
    scene, checkpoint = Scene(t), scratch_path(t.spark, "ingest")
    row = upload(t, scene.lake, scene.acme, "many.csv", messy_orders(t).repartition(12), "csv")
    for known in ([], [row]):
        ingest.start_ingest(scene.lake, lambda known=known: registry(t, known), checkpoint, max_files=5).awaitTermination()
    return scene.lake.read(scene.acme, "orders")
