import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silverbrook.functions import coltypes, naming
from silverbrook.sources import readers

CLEANED = {
    "Order ID (#)": "order_id", "  A--B  ": "a_b", "__x__y__": "x_y", "Größe m²": "größe_m²", "###": "",
    "naïve Café": "naïve_café", 'say "hi"': "say_hi", "ÀB": "àb", "tab\tname": "tab_name", "x": "x",
}


def values(spark, rule, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


def test_clean_column_matches_examples(spark):
    assert values(spark, naming.clean_column, CLEANED) == list(CLEANED.values())
    assert [naming.clean_name(n) for n in CLEANED] == list(CLEANED.values())


@given(st.text(max_size=20))
@settings(max_examples=200, deadline=None)
def test_cleaning_twice_changes_nothing(name):
    once = naming.clean_name(name)
    assert naming.clean_name(once) == once.lower()


def test_collisions_and_empty_names():
    assert naming.unique_names(["A B", "a_b", "###", "a b", "a_b_1"]) == ["a_b", "a_b_2", "col_3", "a_b_3", "a_b_1"]
    names = naming.unique_names(["x"] * 5 + ["x_1"] * 2)
    assert len(set(names)) == 7


def test_web_names_keep_inner_underscores(spark):
    assert values(spark, naming.web_name, ["a  b", "_Ab_", "É x", None]) == ["a__b", "ab", "x", ""]


def test_table_names(spark):
    names = ["Sales 2024", "dataset", " DataSet ", "#", "a", "ab", "", "__x1__"]
    assert values(spark, naming.ingest_table_name, names) == ["sales_2024", "dataset", "dataset", "", "a", "ab", "", "x1"]
    assert values(spark, naming.is_valid_table_name, names) == [True, False, False, False, False, True, False, True]
    assert values(spark, naming.gold_object_name, [" By Status!", "_x_"]) == ["by_status_", "_x_"]


def test_tenant_names(spark):
    df = spark.createDataFrame(
        [(0, "Acme", "x"), (1, "tenant_b", "x"), (2, None, "New Co."), (3, "##", "a-b")], "i int, s string, n string")
    got = [r[0] for r in df.orderBy("i").select(naming.tenant_slug(F.col("s"), F.col("n"))).collect()]
    assert got == ["tenant_acme", "tenant_b", "tenant_new_co_", "tenant_a-b"]
    shown = values(spark, naming.friendly_tenant_name, ["tenant_acme", "tenant_my-co_two", "tenant_b"])
    assert shown == ["Acme Corp (EU-Prod)", "Tenant My-Co Two", "Tenant Beta"]


@pytest.mark.parametrize("text,category", [
    ("BIGINT", "INTEGER"), ("interval", "INTEGER"), ("DECIMAL(18,2)", "FLOAT"), ("TIMESTAMPTZ", "DATETIME"),
    ("BOOLEAN", "BOOLEAN"), ("uuid", "UUID"), ("JSON", "JSON"), ("VARCHAR", "STRING"), ("STRUCT(a VARCHAR)", "STRING"),
    ("STRUCT(a BIGINT)", "INTEGER"), ("BLOB", "OTHER"), (None, "OTHER"),
])
def test_type_category(spark, text, category):
    assert values(spark, coltypes.type_category, [text]) == [category]


@pytest.mark.parametrize("name,type_text,kind", [
    ("id", "BIGINT", "identifier"), ("user_id", "VARCHAR", "identifier"), ("user_id", "INTEGER", "integer"),
    ("d", "DATE", "date"), ("price_at", "TIMESTAMP", "timestamp"), ("unit_price", "DOUBLE", "financial"),
    ("n", "HUGEINT", "integer"), ("x", "REAL", "float"), ("b", "BOOL", "boolean"), ("m", "MAP(x)", "json"),
    ("l", "VARCHAR LIST", "list"), ("t", "VARCHAR", "text"),
])
def test_semantic_kind(spark, name, type_text, kind):
    df = spark.createDataFrame([(name, type_text)], "n string, t string")
    assert df.select(coltypes.semantic_kind(F.col("n"), F.col("t"))).first()[0] == kind


def test_format_dispatch_order():
    assert readers.file_format("x.csv", "parquet") == "csv"
    assert readers.file_format("x.parquet", "csv") == "csv"
    assert readers.file_format("x.json", "parquet") == "parquet"
    assert readers.file_format("x.ndjson") == "json"
    assert readers.file_format("x.unknown") == "csv"
    assert readers.upload_format("a.ndjson") == "json" and readers.upload_format("a.txt") == "csv"
    assert readers.locate("raw/a.csv", "s3a://b") == "s3a://b/raw/a.csv"
    assert readers.locate("s3://b/a.csv", "s3a://c") == "s3://b/a.csv"
