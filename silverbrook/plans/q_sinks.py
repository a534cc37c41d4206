"""Queries over table commits, Gold objects, removal and exports."""

import uuid

from pyspark.sql import functions as F

from silverbrook.operators import export, gold, lineage
from silverbrook.operators.tables import Lake, visible_rows, without_tenants
from silverbrook.plans import feeds
from silverbrook.plans.q_sources import CSV_OPTIONS, dropped, messy_orders
from silverbrook.plans.registry import Tables, query
from silverbrook.plans.tenant_query import TenantGuard
from silverbrook.session import scratch_path
from silverbrook.sources import readers


class Scene:
    """An empty lake and two tenants whose catalog names no other run or user has."""

    def __init__(self, t: Tables):
        tag = uuid.uuid4().hex[:10]
        self.lake = Lake(t.spark, scratch_path(t.spark, "lake"))
        self.acme, self.globex = f"tenant_{tag}a", f"tenant_{tag}b"
        self.guard = TenantGuard(t.spark, [self.acme, self.globex])

    def commit(self, df, table="sales", tenant=None, **options):
        return self.lake.commit(tenant or self.acme, table, df, **options)


@query("snk_create", feeds.ORDERS_CLEAN_SQL)
def snk_create(t: Tables):
    """Raw CSV to a Silver table, read back through its flat alias."""
    scene = Scene(t)
    raw = dropped(messy_orders(t), t, "raw", "csv", **CSV_OPTIONS)
    scene.commit(readers.read_csv(t.spark, raw), "orders")
    return t.spark.table(f"{scene.acme}_orders")


@query("snk_append", """
SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'P'""")
def snk_append(t: Tables):
    """Three batches: create, append by name, append by position; a repeat changes nothing."""
    scene = Scene(t)
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    batch = {s: rows.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in "FOP"}
    scene.commit(batch["F"], batch_id="b1")
    scene.commit(batch["O"].select("o_totalprice", "o_orderkey", "o_custkey"), batch_id="b2")
    scene.commit(batch["P"].toDF("a", "b", "c"), batch_id="b3", mode="by_position")
    scene.commit(batch["P"].toDF("a", "b", "c"), batch_id="b3", mode="by_position")
    return t.spark.table(f"{scene.acme}_silver.sales")


@query("snk_evolve", """
SELECT o_orderkey, o_custkey, CAST(NULL AS STRING) AS o_orderstatus FROM {orders} WHERE o_totalprice < 200000
UNION ALL SELECT o_orderkey, CAST(NULL AS BIGINT), o_orderstatus FROM {orders} WHERE o_totalprice >= 200000""")
def snk_evolve(t: Tables):
    """A batch may bring new columns and leave out old ones."""
    scene = Scene(t)
    scene.commit(t.orders.filter("o_totalprice < 200000").select("o_orderkey", "o_custkey"))
    scene.commit(t.orders.filter("o_totalprice >= 200000").select("o_orderstatus", "o_orderkey"),
                mode="evolve")
    return scene.lake.read(scene.acme, "sales")


@query("snk_snapshot_asof", """
SELECT o_orderstatus, 'as_of_2' AS version, count(*) AS n FROM {orders} WHERE o_orderstatus IN ('F', 'O') GROUP BY 1
UNION ALL SELECT o_orderstatus, 'now', count(*) FROM {orders} GROUP BY 1""")
def snk_snapshot_asof(t: Tables):
    """Three commits and one unpublished batch: reads see committed snapshots only."""
    scene = Scene(t)
    for s in "FOP":
        scene.commit(t.orders.filter(F.col("o_orderstatus") == s), batch_id=f"b{s}")
    scene.commit(t.orders, batch_id="hidden", publish=False)

    def counted(df, label):
        return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(label))

    return counted(scene.lake.read(scene.acme, "sales", as_of=2), "as_of_2").unionByName(counted(scene.lake.read(scene.acme, "sales"), "now"))


@query("snk_visible_rows", f"""
SELECT d.dataset_id, d.tenant_id, d.row_count FROM ({feeds.DATASETS}) AS d
WHERE EXISTS (SELECT 1 FROM ({feeds.TENANTS}) AS c WHERE c.slug = d.tenant_id AND c.active)""")
def snk_visible_rows(t: Tables):
    """Commit visibility as a semi-join: data of registered, active owners only."""
    commits = t.sql(feeds.TENANTS).filter("active").select(F.col("slug").alias("tenant_id"))
    return visible_rows(t.sql(feeds.DATASETS), commits, keys=("tenant_id",)).select(
        "dataset_id", "tenant_id", "row_count")


@query("snk_metrics", """
WITH b AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus <> 'F') AS r FROM {orders})
SELECT 1 AS snapshot_id, f AS batch_rows, f AS total_rows, 6 AS n_columns FROM b
UNION ALL SELECT 2, r, f + r, 6 FROM b""")
def snk_metrics(t: Tables):
    """Batch and table row counts, measured while the batch is written."""
    scene = Scene(t)
    done = [
        scene.commit(t.orders.filter("o_orderstatus = 'F'")),
        scene.commit(t.orders.filter("o_orderstatus <> 'F'")),
    ]
    return t.spark.createDataFrame(
        [(d.snapshot_id, d.batch_rows, d.total_rows, len(d.columns)) for d in done],
        "snapshot_id int, batch_rows bigint, total_rows bigint, n_columns int")


def _sales(t: Tables) -> tuple[Scene, str]:
    """A first batch of orders and the Gold definition over its table."""
    scene = Scene(t)
    scene.commit(t.orders.filter("o_orderstatus = 'F'"))
    return scene, f"""SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top
        FROM {scene.acme}_silver.sales GROUP BY o_orderstatus;"""


GOLD_ORACLE = "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM {orders} GROUP BY o_orderstatus"


@query("gold_view", GOLD_ORACLE)
def gold_view(t: Tables):
    """A Gold view shows rows committed after it was created."""
    scene, sql = _sales(t)
    view = gold.create_view(scene.lake, scene.guard, scene.acme, "By Status", sql)
    scene.commit(t.orders.filter("o_orderstatus <> 'F'"))
    return t.spark.table(view.full_name)


@query("gold_materialize", GOLD_ORACLE)
def gold_materialize(t: Tables):
    """Materialising twice replaces the first result."""
    scene, sql = _sales(t)
    gold.materialize(scene.lake, scene.guard, scene.acme, "by_status", sql)
    scene.commit(t.orders.filter("o_orderstatus <> 'F'"))
    return t.spark.table(gold.materialize(scene.lake, scene.guard, scene.acme, "by_status", sql).full_name)


@query("snk_drop_isolated", "SELECT 'tenant_globex' AS tenant_id, count(*) AS n FROM {orders}")
def snk_drop_isolated(t: Tables):
    """Dropping one tenant's table leaves the other tenant's table of the same name alone."""
    scene = Scene(t)
    for tenant in (scene.acme, scene.globex):
        scene.commit(t.orders, tenant=tenant)
    scene.lake.drop(scene.acme, "sales")
    label = F.when(F.col("tenant_id") == scene.globex, "tenant_globex").otherwise("tenant_acme")
    left = scene.lake.commits().select(label.alias("tenant_id")).distinct()
    kept = scene.lake.read(scene.globex, "sales").agg(F.count(F.lit(1)).alias("n"))
    return left.withColumn("n", kept.scalar())


@query("snk_purge_tenant", f"""
SELECT d.dataset_id, d.tenant_id, d.status FROM ({feeds.DATASETS}) AS d
WHERE NOT EXISTS (SELECT 1 FROM ({feeds.TENANTS}) AS c WHERE c.slug = d.tenant_id AND c.status = 'inactive')""")
def snk_purge_tenant(t: Tables):
    """Registry rows left once every inactive tenant is purged."""
    gone = t.sql(feeds.TENANTS).filter("status = 'inactive'").select(F.col("slug").alias("tenant_id"))
    return without_tenants(t.sql(feeds.DATASETS), gone).select("dataset_id", "tenant_id", "status")


@query("snk_purge_stored", """
SELECT 'tenant_globex' AS tenant_id, count(*) AS n FROM {orders} HAVING count(*) > 0""")
def snk_purge_stored(t: Tables):
    """Purging one tenant, twice, removes its tables and leaves the other's alone."""
    scene = Scene(t)
    for tenant in (scene.acme, scene.globex):
        scene.commit(t.orders, tenant=tenant)
    for _ in range(2):
        scene.lake.purge_tenant(scene.acme)
    label = F.when(F.col("tenant_id") == scene.globex, "tenant_globex").otherwise("tenant_acme")
    return scene.lake.commits().select(label.alias("tenant_id"), F.col("total_rows").alias("n"))


@query("gold_rebuild", """
SELECT c_mktsegment, count(*) AS n FROM {customer} GROUP BY 1""")
def gold_rebuild(t: Tables):
    """The catalog is lost; tables come back from the log and views from their definitions."""
    scene = Scene(t)
    scene.commit(t.customer, "customers")
    source = f"SELECT c_mktsegment FROM {scene.acme}_customers"
    for i in range(9, 0, -1):  # a chain of ten, each name before that of the view it reads
        gold.create_view(scene.lake, scene.guard, scene.acme, f"v{i}", source)
        source = f"SELECT * FROM {scene.acme}_gold.v{i}"
    gold.create_view(scene.lake, scene.guard, scene.acme, "a_top",
                     f"SELECT c_mktsegment, count(*) AS n FROM {scene.acme}_gold.v1 GROUP BY 1")
    for schema in ("silver", "gold"):
        t.spark.sql(f"DROP SCHEMA `{scene.acme}_{schema}` CASCADE")
    scene.lake.publish_all()
    gold.restore_views(scene.lake)
    return t.spark.table(f"{scene.acme}_gold.a_top")


@query("snk_drop_refused", """
SELECT 'kept' AS state, count(*) AS n FROM {orders} UNION ALL SELECT 'gone', 0 FROM {orders} HAVING count(*) > 0""")
def snk_drop_refused(t: Tables):
    """A table that a view reads stays until the drop is forced."""
    scene = Scene(t)
    scene.commit(t.orders.select("o_orderkey"), "orders")
    gold.create_view(scene.lake, scene.guard, scene.acme, "v", f"SELECT * FROM {scene.acme}_silver.orders")
    try:
        gold.drop(scene.lake, scene.acme, "orders")
    except lineage.DependentsError:
        pass
    kept = scene.lake.read(scene.acme, "orders").agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("state"), "n")
    seen = kept.collect()
    gold.drop(scene.lake, scene.acme, "orders", force=True)
    left = scene.lake.history(scene.acme, "orders").agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("n"))
    return t.spark.createDataFrame(seen, kept.schema).unionAll(left.select(F.lit("gone"), "n"))


EXPORT_INPUT = """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN p_name || ', "' || p_brand || '"'
         WHEN 2 THEN p_name || chr(9) || p_type ELSE p_name || chr(10) || p_type END AS label,
       p_size FROM {part}"""


@query("exp_csv", f"""
SELECT CAST(p_partkey AS STRING) || ',' ||
       CASE WHEN label IS NULL THEN '' WHEN label LIKE '%,%' OR label LIKE '%"%' OR contains(label, chr(10))
            THEN '"' || replace(label, '"', '""') || '"' ELSE label END || ',' || CAST(p_size AS STRING) AS line
FROM ({EXPORT_INPUT}) AS e""")
def exp_csv(t: Tables):
    return export.csv_lines(t.sql(EXPORT_INPUT))


@query("exp_csv_files", EXPORT_INPUT)
def exp_csv_files(t: Tables):
    """CSV export read back: line breaks, quotes and nulls survive."""
    path = export.export_csv(t.sql(EXPORT_INPUT), scratch_path(t.spark, "export-csv"))
    return readers.read_csv(t.spark, path, t.sql(EXPORT_INPUT).schema)


@query("exp_json", f"""
SELECT '{{"p_partkey":' || CAST(p_partkey AS STRING) || ',"label":' || coalesce(CAST(to_json(label) AS STRING), 'null')
       || ',"p_size":' || CAST(p_size AS STRING) || '}}' AS line FROM ({EXPORT_INPUT}) AS e""")
def exp_json(t: Tables):
    return export.json_lines(t.sql(EXPORT_INPUT))


@query("exp_tsv", f"""
SELECT CAST(p_partkey AS STRING) || chr(9) || coalesce(replace(label, chr(9), ' '), '') || chr(9)
       || CAST(p_size AS STRING) AS line FROM ({EXPORT_INPUT}) AS e""")
def exp_tsv(t: Tables):
    return export.tsv_lines(t.sql(EXPORT_INPUT))


@query("snk_manifest_diff", """
WITH d AS (SELECT DISTINCT o_orderpriority AS p FROM {orders})
SELECT 'removed' AS change, 4 AS n FROM d WHERE p = '1-URGENT' UNION ALL
SELECT 'added', 4 FROM d WHERE p = '5-LOW' UNION ALL
SELECT 'changed', 4 FROM d WHERE p = '3-MEDIUM'""")
def snk_manifest_diff(t: Tables):
    """Two backups of the orders: one folder goes, one changes, one comes. Files are compared by the roots of their trees."""
    def backup(rows, label):
        root = scratch_path(t.spark, label)
        rows.repartition(4, "o_orderkey").sortWithinPartitions("o_orderpriority", "o_orderkey").write.partitionBy(
            "o_orderpriority").json(root)
        # Part names end in a random tag; what precedes it identifies the part.
        return export.manifest(t.spark, root, "*.json", piece=1 << 14, fan=4).withColumn(
            "path", F.regexp_extract("path", r"^(.*/part-\d+)", 1))

    before = backup(t.orders.filter("o_orderpriority <> '5-LOW'"), "before")
    later = t.orders.filter("o_orderpriority <> '1-URGENT'").withColumn(
        "o_totalprice", F.when(F.col("o_orderpriority") == "3-MEDIUM", F.col("o_totalprice") + 1)
        .otherwise(F.col("o_totalprice")))
    changes = export.manifest_diff(before, backup(later, "after"))
    return changes.groupBy("change").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("snk_vacuum", """
SELECT 'removed' AS what, 'hidden' AS item, count(*) AS n_rows FROM (SELECT 1 FROM {orders} HAVING count(*) > 0)
UNION ALL SELECT 'removed', 'replaced', count(*) FROM (SELECT 1 FROM {orders} HAVING count(*) > 0)
UNION ALL SELECT 'now', o_orderstatus, count(*) FROM {orders} WHERE o_orderstatus <> 'F' GROUP BY 2
UNION ALL SELECT 'as of 2', o_orderstatus, count(*) FROM {orders} WHERE o_orderstatus = 'O' GROUP BY 2""")
def snk_vacuum(t: Tables):
    """What no retained snapshot shows goes: a replaced batch and one never committed. The rest reads as before."""
    scene = Scene(t)
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    batch = {s: rows.filter(F.col("o_orderstatus") == s) for s in "FOP"}
    scene.commit(batch["F"], batch_id="b1")
    scene.commit(batch["O"], batch_id="b2", replace=True)
    scene.commit(batch["P"], batch_id="b3")
    scene.commit(batch["F"], batch_id="b4", publish=False)
    gone = scene.lake.vacuum(scene.acme, "sales", oldest=2, hidden_hours=0)
    parts = [gone.groupBy(F.lit("removed").alias("what"), F.col("reason").alias("item")).agg(F.count("*").alias("n_rows"))]
    for what, at in (("now", None), ("as of 2", 2)):
        parts.append(scene.lake.read(scene.acme, "sales", as_of=at).groupBy(
            F.lit(what).alias("what"), F.col("o_orderstatus").alias("item")).agg(F.count("*").alias("n_rows")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
