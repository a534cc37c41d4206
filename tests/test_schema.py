"""Inference, matching and suggestions against straightforward per-item versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from silverbrook.functions import coltypes, naming
from silverbrook.operators import name_suggest, schema_infer, schema_match

COLUMNS = "tenant_id string, dataset_id bigint, ordinal bigint, name string, type string, layer string"


def test_infer_text(spark):
    df = spark.createDataFrame([
        ("1", "1.5", "2026-01-01x", "0f8fad5b-d9cb", "a", "", "1"),
        ("-2", "-.5", "2026-01-02", "0F8FAD5B-D9CB-1", "2", "NULL", "null"),
    ], "i string, d string, t string, u string, m string, e string, n string")
    got = {r.name: (r.type, r.nullable, r.sample) for r in schema_infer.infer_text(df).collect()}
    assert got == {
        "i": ("bigint", False, "-2"), "d": ("decimal", False, "-.5"), "t": ("timestamp", False, "2026-01-01x"),
        "u": ("uuid", False, "0F8FAD5B-D9CB-1"), "m": ("varchar", False, "2"), "e": ("varchar", True, "—"),
        "n": ("bigint", True, "1")}
    first = {r.name: r.type for r in schema_infer.infer_text(df.coalesce(1), mode="first_row").collect()}
    assert first["m"] == "varchar" and first["n"] == "bigint"


def test_infer_json(spark):
    docs = ['{"a":1,"b":1.5,"c":"x","d":null,"e":{"x":1},"f":[1],"g":true,"h":5.0}',
            '{"a":2,"b":2,"c":"2026-01-01","d":null,"e":null,"f":[],"g":false,"h":6}', "not json"]
    got = {r.name: (r.type, r.nullable) for r in schema_infer.infer_json(
        spark.createDataFrame([(d,) for d in docs], "doc string"), "doc").collect()}
    assert got == {"a": ("bigint", False), "b": ("varchar", False), "c": ("varchar", False), "d": ("varchar", True),
                   "e": ("json", True), "f": ("json", False), "g": ("boolean", False), "h": ("bigint", False)}


def _brute_force(columns, limit=30):
    """Score every file with every table of its tenant, one pair at a time."""
    files, tables = {}, {}
    for tenant, dataset, ordinal, name, key, category, type_text, layer in columns:
        side = files if layer == "file" else tables if layer == "silver" else None
        if side is not None:
            side.setdefault((tenant, dataset), []).append((ordinal, name, key, category, type_text))
    out = set()
    for (ft, f), (tt, t) in itertools.product(files, tables):
        if ft != tt:
            continue
        mine, theirs = sorted(files[ft, f]), sorted(tables[tt, t])
        exact = soft = matched = 0
        for _, _, key, category, type_text in mine:
            partner = next((c for c in theirs if c[2] == key), None)
            if partner:
                matched += 1
                if type_text.lower() == partner[4].lower() or category == partner[3]:
                    exact += 1
                elif "STRING" in (category, partner[3]):
                    soft += 1
        weight = exact + 0.75 * soft + 0.5 * (matched - exact - soft)
        score = int(weight / max(len(mine), len(theirs)) * 100 + 0.5)
        if score >= limit or matched >= 3:
            out.add((ft, f, t, score, matched, exact, soft))
    return out


def test_matching_finds_exactly_what_all_pairs_would(spark):
    random.seed(3)
    pool = ["id", "ID ", "created_at", "Created-At"] + [f"c{i}" for i in range(25)]
    types = ["BIGINT", "VARCHAR", "DOUBLE", "TIMESTAMP", "text", "BLOB"]
    data = []
    for d in range(160):
        width = random.choice([1, 2, 3, 4, 5, 6, 7, 9, 14])
        # Nearly every data set has an id column; some repeat a key under other spellings.
        names = ["id"] * (random.random() < 0.8) + random.choices(pool, k=width)
        names = list(dict.fromkeys(names)) if random.random() < 0.7 else names
        tenant, layer = f"t{int(random.random() < 0.3)}", random.choice(["file", "silver", "silver", "gold"])
        data += [(tenant, d, i, n, random.choice(types), layer) for i, n in enumerate(names)]
    columns = spark.createDataFrame(data, COLUMNS)
    keyed = columns.select("tenant_id", "dataset_id", "ordinal", "name", naming.web_name(F.col("name")),
                           coltypes.type_category(F.col("type")), "type", "layer")
    expected = _brute_force([tuple(r) for r in keyed.collect()])
    got = schema_match.match_scores(columns.filter("layer = 'file'"), columns.filter("layer <> 'file'"))
    found = {tuple(r) for r in got.select("tenant_id", "file_id", "table_id", "score", "matched", "exact_matches",
                                          "compatible_matches").collect()}
    assert found == expected and len(expected) > 200
    rows = [tuple(r) for r in keyed.collect()]
    sizes = set()
    for limit in (1, 10, 55, 100, 101):
        got = schema_match.match_scores(columns.filter("layer = 'file'"), columns.filter("layer <> 'file'"), limit)
        found = {tuple(r) for r in got.select("tenant_id", "file_id", "table_id", "score", "matched", "exact_matches",
                                              "compatible_matches").collect()}
        assert found == _brute_force(rows, limit), limit
        sizes.add(len(found))
    assert len(sizes) > 3
    with pytest.raises(ValueError):
        schema_match.match_scores(columns.filter("layer = 'file'"), columns.filter("layer <> 'file'"), 0)


def test_ranking_and_bands(spark):
    rows = [("t", 1, i, n, ty, "file") for i, (n, ty) in enumerate([("a", "BIGINT"), ("b", "VARCHAR"), ("c", "DATE")])]
    rows += [("t", 10, i, n, ty, "silver") for i, (n, ty) in enumerate([("A", "INT"), ("b", "TEXT"), ("c", "TIME")])]
    rows += [("t", 11, i, n, ty, "silver") for i, (n, ty) in enumerate([("a", "VARCHAR"), ("x", "DATE")])]
    rows += [("t", 12, 0, "a", "BIGINT", "gold")]
    columns = spark.createDataFrame(rows, COLUMNS)
    ranked = schema_match.ranked_matches(columns.filter("layer = 'file'"), columns.filter("layer <> 'file'")).collect()
    assert [(r.table_id, r.score, r["rank"], r.band, r.auto_selected) for r in ranked] == [(10, 100, 1, "exact", True)]
    left = schema_match.unmatched_columns(columns.filter("layer = 'file'"), columns.filter("layer <> 'file'")).collect()
    assert left == []


def suggestions(spark, filename, columns):
    files = spark.createDataFrame([(1, filename)], "file_id int, filename string")
    cols = spark.createDataFrame([(1, i, c) for i, c in enumerate(columns)], "file_id int, ordinal bigint, name string")
    return [r.name for r in name_suggest.suggest_names(files, cols).orderBy("rank").collect()]


def test_name_suggestions(spark):
    assert suggestions(spark, "Customer Export 2026-09-15.csv", []) == ["customer", "customers", "customer_export_2026_09_15"]
    assert suggestions(spark, "data.csv", ["note"]) == ["ingested_records", "source_data", "imported_table"]
    assert suggestions(spark, "x.csv", ["user_id", "price", "quantity", "city"]) == [
        "users", "orders", "sales_transactions", "locations"]
    assert suggestions(spark, "raw.json", ["widget_id", "ab_id", "gpa", "salary", "payload", "tier"]) == [
        "widgets", "student_performance", "academic_records", "customer_subscriptions", "activity_events"]
    assert suggestions(spark, "test.csv", ["temp"]) == ["tests"]


def test_dataset_columns_meet_in_more_tasks_as_they_grow(spark, monkeypatch):
    from silverbrook import session
    from silverbrook.plans import feeds
    from silverbrook.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    got = feeds.dataset_columns(t)
    sizes = [n for n in got.rdd.glom().map(len).collect() if n]
    assert len(sizes) > 40 and max(sizes) < 250
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, t.sql(feeds.DATASET_COLUMNS).collect()))
