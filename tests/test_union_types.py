"""Parquet files that disagree on columns and types."""

import datetime as dt
import decimal

from pyspark.sql import types as T

from silverbrook.sources import readers


def test_common_types(spark):
    got = {(a, b): readers.common_type(T._parse_datatype_string(a), T._parse_datatype_string(b)).simpleString() for a, b in [
        ("byte", "long"), ("int", "float"), ("long", "double"), ("decimal(10,2)", "decimal(8,4)"), ("decimal(38,0)", "decimal(38,10)"),
        ("decimal(5,2)", "int"), ("date", "timestamp_ntz"), ("date", "timestamp"), ("int", "string"), ("boolean", "int"),
        ("date", "long"), ("void", "int"), ("array<int>", "array<string>"), ("map<string,int>", "map<string,long>"),
        ("struct<a:int>", "struct<a:long,b:string>"), ("struct<a:int>", "string")]}
    assert list(got.values()) == [
        "bigint", "double", "double", "decimal(12,4)", "double", "double", "timestamp_ntz", "timestamp", "string", "string",
        "string", "int", "array<string>", "map<string,bigint>", "struct<a:bigint,b:string>", "string"]
    for a, b in got:
        assert got[a, b] == readers.common_type(T._parse_datatype_string(b), T._parse_datatype_string(a)).simpleString() or "struct" in a


def test_files_of_one_folder_are_united(spark, tmp_path):
    rows = [("a", "id int, v int, s struct<x:int>, l array<int>", [(1, 2, (3,), [4])]),
            ("b", "v string, id long, s struct<x:double,y:string>, l array<string>", [("two", 5, (1.5, "z"), ["q", None]), (None, 6, None, None)]),
            ("c", "id long, v date, extra decimal(5,2)", [(7, dt.date(2024, 1, 2), decimal.Decimal("1.25"))]),
            ("d", "id long, v date, extra decimal(7,1)", [])]
    for name, schema, data in rows:
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "all"))
    df = readers.read_union_by_name(spark, str(tmp_path / "all"))
    assert {f.name: f.dataType.simpleString() for f in df.schema.fields} == {
        "id": "bigint", "v": "string", "s": "struct<x:double,y:string>", "l": "array<string>", "extra": "decimal(8,2)"}
    got = {r.id: (r.v, r.s and tuple(r.s), r["l"], r.extra) for r in df.collect()}
    assert got == {1: ("2", (3.0, None), ["4"], None), 5: ("two", (1.5, "z"), ["q", None], None), 6: (None, None, None, None),
                   7: ("2024-01-02", None, None, decimal.Decimal("1.25"))}
    assert df.where("id = 7").count() == 1
    spark.range(3).write.parquet(str(tmp_path / "one"))
    assert readers.read_union_by_name(spark, [str(tmp_path / "one"), str(tmp_path / "all")]).count() == 7
