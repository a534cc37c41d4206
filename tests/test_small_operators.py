"""Small operators of the catalog, access, export and ingestion modules."""

import json

from silverbrook.operators import access, catalog, export, jobs, schema_infer
from silverbrook.streaming import ingest


def test_table_search(spark):
    tables = spark.createDataFrame([("Orders", "t_silver.Orders"), ("items", "t_gold.items")], "name string, full_name string")
    assert [r.name for r in jobs.search_tables(tables, "GOLD").collect()] == ["items"]
    assert [r.name for r in jobs.search_tables(tables, "order").collect()] == ["Orders"]


def test_visible_tenants(spark):
    tenants = spark.createDataFrame([("a",), ("b",)], "slug string")
    assert [r.slug for r in access.visible_tenants(tenants, access.Caller("u", "tenant_user", "b")).collect()] == ["b"]
    assert access.visible_tenants(tenants, access.Caller("u", access.ADMIN)).count() == 2
    assert access.visible_tenants(tenants, None).count() == 0


def test_columns_of_tables(spark, lake):
    lake.commit("tenant_x", "t", spark.createDataFrame([(1, "a")], "id long, name string"))
    rows = catalog.table_columns(spark, ["tenant_x_silver.t"]).collect()
    assert [(r.full_name, r.ordinal, r.name, r.type) for r in rows] == [
        ("tenant_x_silver.t", 1, "id", "bigint"), ("tenant_x_silver.t", 2, "name", "string")]
    profile = schema_infer.column_profile(spark.table("tenant_x_silver.t")).collect()
    assert [(r.ordinal, r.name, r.type, r.nullable) for r in profile] == [(1, "id", "bigint", True), (2, "name", "string", True)]


def test_manifest_totals_and_json_export(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string").coalesce(1)
    export.export_json(df, str(tmp_path / "j"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert lines == [{"a": 1, "b": None}, {"a": 2, "b": "x"}]
    total = export.manifest_totals(export.manifest(spark, str(tmp_path / "j"), "*.json")).first()
    assert total.n_files == 1 and total.n_bytes == sum(len(json.dumps(x, separators=(",", ":"))) + 1 for x in lines)


def test_uploads_from_datasets(spark):
    datasets = spark.createDataFrame(
        [("raw/a.csv", "t", "t_silver.a", "csv", "silver"), ("raw/g", "t", "t_gold.g", "csv", "gold")],
        "raw_file_path string, tenant_id string, table_fqn string, format string, layer string")
    assert [tuple(r) for r in ingest.uploads_from(datasets).collect()] == [("raw/a.csv", "t", "a", "csv")]


def test_columns_and_objects_of_the_commit_log(spark, lake):
    from silverbrook.operators import catalog

    lake.commit("tenant_x", "t", spark.createDataFrame([(1, 2.0, [1])], "a int, b double, c array<int>"))
    lake.commit("tenant_x", "t", spark.createDataFrame([(1, "q")], "a int, d string"), mode="evolve")
    lake.commit("tenant_x", "g", spark.range(1), layer="gold")
    got = sorted(map(tuple, catalog.logged_columns(lake.commits()).collect()))
    assert [r[:3] for r in got] == [("tenant_x_gold.g", 1, "id"), ("tenant_x_silver.t", 1, "a"), ("tenant_x_silver.t", 2, "b"),
                                    ("tenant_x_silver.t", 3, "c"), ("tenant_x_silver.t", 4, "d")]
    assert [r[3] for r in got if r[2] in "abd"] == ["int", "double", "string"] and got[0][3] == "bigint"
    listed = {r.full_name for r in catalog.list_tables(catalog.logged_objects(lake.commits())).collect()}
    assert listed == {r.full_name for r in catalog.list_tables(catalog.session_objects(spark)).collect()}
