"""Commits, visibility, Gold objects, removal and the acceptance loop."""

import os

import pytest
from pyspark.sql import functions as F

from silverbrook.operators import catalog, gold
from silverbrook.operators.tables import BatchRejected
from silverbrook.plans.tenant_query import QueryRefused, TenantGuard, tenant_sql
from silverbrook.sources import readers, storage

T = "tenant_acme"

BATCH_1 = """reading_id,sensor,value_c,taken_at
r1,roof,21,2025-03-01 08:00:00
r2,cellar,9,2025-03-01 08:00:00
r3,yard,17,2025-03-01 08:05:00
r4,roof,24,2025-03-01 09:00:00
"""
BATCH_2 = """reading_id,sensor,value_c,taken_at
r5,cellar,10,2025-03-01 09:00:00
r6,yard,19,2025-03-01 09:05:00
"""


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_acceptance_loop(spark, lake, tmp_path):
    guard = TenantGuard(spark, [T, "tenant_globex"])
    first = readers.read_any(spark, write(tmp_path / "analytics_events.csv", BATCH_1))
    assert dict(first.dtypes)["value_c"] == "bigint"
    assert dict(first.dtypes)["taken_at"] == "timestamp_ntz"
    done = lake.commit(T, "events", first)
    assert (done.table, done.batch_rows, done.total_rows) == (f"{T}_silver.events", 4, 4)
    listed = catalog.list_tables(catalog.session_objects(spark), T)
    assert rows(listed.select("full_name", "name", "layer")) == [
        (f"{T}_events", "events", "silver"), (f"{T}_silver.events", "events", "silver")]
    result = tenant_sql(spark, guard, T, f"""SELECT sensor, value_c FROM {T}_events
        WHERE value_c > 15 ORDER BY value_c DESC""")
    assert result.columns == ["sensor", "value_c"]
    assert [r.value_c for r in result.fetch()[0]] == [24, 21, 17]
    second = readers.read_csv(spark, write(tmp_path / "batch2.csv", BATCH_2), schema=lake.schema_of(T, "events"))
    done = lake.commit(T, "events", second)
    assert (done.batch_rows, done.total_rows, done.snapshot_id) == (2, 6, 2)
    assert tenant_sql(spark, guard, T, f"SELECT count(*) FROM {T}_events").fetch()[0][0][0] == 6
    with pytest.raises(QueryRefused, match="Cross-tenant table access prohibited"):
        tenant_sql(spark, guard, T, "SELECT * FROM tenant_globex_secret_records")


def test_append_modes(spark, lake):
    base = spark.createDataFrame([(1, "a")], "id bigint, name string")
    lake.commit(T, "t", base)
    lake.commit(T, "t", base.select("name", "id"))
    lake.commit(T, "t", base.toDF("x", "y"), mode="by_position")
    with pytest.raises(ValueError):
        lake.commit(T, "t", base.select("id"))
    with pytest.raises(ValueError):
        lake.commit(T, "t", base.withColumn("z", F.lit(1)), mode="by_position")
    with pytest.raises(ValueError):
        lake.commit(T, "t", base.toDF("x", "y"))
    lake.commit(T, "t", spark.createDataFrame([(2, True)], "id int, flag boolean"), mode="evolve")
    assert lake.read(T, "t").columns == ["id", "name", "flag"]
    assert sorted(map(str, lake.read(T, "t").collect())) == sorted(map(str, spark.table(f"{T}_t").collect()))
    assert rows(lake.read(T, "t", as_of=1)) == [(1, "a", None)]
    assert lake.read(T, "t").count() == 4


def test_batches_are_repeatable_and_hidden_until_committed(spark, lake):
    one, two = spark.range(3), spark.range(5)
    lake.commit(T, "t", one, batch_id="b1")
    lake.commit(T, "t", one, batch_id="b1")
    lake.commit(T, "t", two, batch_id="b2", publish=False)
    assert lake.read(T, "t").count() == spark.table(f"{T}_t").count() == 3
    with pytest.raises(BatchRejected):
        lake.commit(T, "t", two, batch_id="b3", audit=lambda written: written.count() > 5)
    assert spark.table(f"{T}_t").count() == 3
    # A half written batch is written anew under its own id.
    lake.commit(T, "t", two, batch_id="b2")
    assert lake.read(T, "t").count() == spark.table(f"{T}_t").count() == 8
    lake.commit(T, "t", one, replace=True)
    assert lake.read(T, "t").count() == spark.table(f"{T}_t").count() == 3
    assert lake.read(T, "t", as_of=2).count() == 8


def test_catalog_can_be_rebuilt(spark, lake):
    lake.commit(T, "t", spark.range(3))
    lake.commit(T, "g", spark.range(2), layer="gold")
    spark.sql(f"DROP SCHEMA {T}_silver CASCADE")
    spark.sql(f"DROP SCHEMA {T}_gold CASCADE")
    assert sorted(lake.publish_all(T)) == [f"{T}_gold.g", f"{T}_silver.t"]
    assert spark.table(f"{T}_t").count() == 3 and spark.table(f"{T}_gold.g").count() == 2


def test_gold_objects(spark, lake):
    guard = TenantGuard(spark, [T, "tenant_b"])
    lake.commit(T, "t", spark.range(3))
    view = gold.create_view(lake, guard, T, "My View!", f"SELECT count(*) AS n FROM {T}_silver.t;")
    table = gold.materialize(lake, guard, T, "copy", f"SELECT id FROM {T}_t")
    assert (view.full_name, view.columns, table.row_count) == (f"{T}_gold.my_view_", ["n"], 3)
    lake.commit(T, "t", spark.range(2))
    assert spark.table(view.full_name).first().n == 5
    assert gold.materialize(lake, guard, T, "copy", f"SELECT id FROM {T}_t").row_count == 5
    assert gold.materialize(lake, guard, T, "copy", f"SELECT id FROM {T}_t", append=True).row_count == 10
    for sql in ("SELECT * FROM tenant_b_silver.customers", "DROP TABLE x"):
        with pytest.raises(QueryRefused):
            gold.create_view(lake, guard, T, "v", sql)


def test_removal_leaves_other_tenants_alone(spark, lake):
    for tenant in (T, "tenant_acme_b", "tenant_b"):
        lake.commit(tenant, "orders", spark.range(3))
        lake.commit(tenant, "items", spark.range(3))
    assert lake.drop(T, "orders")
    assert not os.path.exists(lake.table_folder(T, "orders"))
    assert lake.read(T, "items").count() == 3
    with pytest.raises(LookupError):
        lake.read(T, "orders")
    assert not lake.drop(T, "items", object_type="view")
    lake.purge_tenant(T)
    assert not os.path.exists(f"{lake.root}/tenants/{T}")
    assert not spark.catalog.databaseExists(f"{T}_silver")
    for tenant in ("tenant_acme_b", "tenant_b"):
        assert spark.table(f"{tenant}_orders").count() == lake.read(tenant, "orders").count() == 3
    assert {r.tenant_id for r in lake.commits().collect()} == {"tenant_acme_b", "tenant_b"}
    for bad in ("../x", "a/b", ""):
        with pytest.raises(ValueError):
            lake.purge_tenant(bad)


def test_storage_discovery(spark, tmp_path):
    root = str(tmp_path)
    spark.range(3).write.parquet(f"{root}/tenants/tenant_x/tables/a")
    spark.range(2).withColumn("b", F.lit(1)).write.mode("append").parquet(f"{root}/tenants/tenant_x/tables/a")
    spark.range(1).write.parquet(f"{root}/tenants/tenant_y/gold/g")
    spark.range(1).write.csv(f"{root}/tenants/tenant_y/tables/c")
    files = storage.list_files(spark, root)
    assert [r.tenant_id for r in storage.tenants_in(files).collect()] == ["tenant_x", "tenant_y"]
    found = storage.tables_in(files)
    assert rows(found.select("tenant_id", "layer", "table_name")) == [
        ("tenant_x", "silver", "a"), ("tenant_y", "gold", "g")]
    assert sorted(storage.register_tables(spark, root, found)) == ["tenant_x_silver.a", "tenant_y_gold.g"]
    assert spark.table("tenant_x_a").agg(F.count("id"), F.count("b")).first()[:] == (5, 2)


def test_readers_keep_types_and_reject_bad_lines(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'A B,"a_b","q ""x"""\n1,"x,y",2026-01-01\n2,,2026-01-02\n')
    df = readers.read_csv(spark, path)
    assert df.dtypes == [("a_b", "bigint"), ("a_b_1", "string"), ("q_x", "date")]
    assert df.count() == 2
    array = write(tmp_path / "a.json", '[{"D-x":"2026-01-01","n":{"k":[1,2]},"t":"x"},\n {"D-x":null,"n":null,"t":"2026-01-01"}]')
    df = readers.read_json(spark, array)
    assert dict(df.dtypes) == {"d_x": "date", "n": "struct<k:array<bigint>>", "t": "string"}
    lines = write(tmp_path / "b.ndjson", '{"at":"2026-01-01T10:00:00"}\n{"at":"2026-01-02 11:00:00"}\n')
    df = readers.read_any(spark, lines)
    assert dict(df.dtypes) == {"at": "timestamp_ntz"} and df.count() == 2
    bad = write(tmp_path / "bad.csv", "a,b\n1,2\nx,3\n")
    schema = readers.read_csv(spark, write(tmp_path / "good.csv", "a,b\n1,2\n")).schema
    with pytest.raises(Exception):
        readers.read_csv(spark, bad, schema=schema).collect()


def test_two_writers_get_different_snapshots(spark, lake):
    from concurrent.futures import ThreadPoolExecutor

    lake.commit(T, "numbers", spark.range(1))
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda n: lake.commit(T, "numbers", spark.range(n), batch_id=f"b{n}"), (10, 20)))
    assert sorted(d.snapshot_id for d in done) == [2, 3]
    totals = {r.snapshot_id: r.total_rows for r in lake.history(T, "numbers").collect()}
    first = min(done, key=lambda d: d.snapshot_id).batch_rows
    assert totals == {1: 1, 2: 1 + first, 3: 31} and lake.read(T, "numbers").count() == 31
    assert lake.read(T, "numbers", as_of=2).count() == 1 + first
    lake.commit(T, "numbers", spark.range(4), replace=True)
    assert [r.total_rows for r in lake.history(T, "numbers").orderBy("snapshot_id").collect()][-1] == 4


def test_exports_keep_blanks_and_names(spark, tmp_path):
    from silverbrook.operators import export
    from silverbrook.sources.readers import read_csv

    df = spark.createDataFrame([("  a ", "x\ny"), (None, "t\tt")], "p string, q string")
    export.export_csv(df.coalesce(1), str(tmp_path / "c"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "c")).collect()), key=repr) == [("  a ", "x\ny"), (None, "t\tt")]
    export.export_tsv(df.filter("p IS NULL").coalesce(1), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["p\tq", "\tt t"]
