import os

from silverbrook.streaming import ingest

T = "tenant_acme"


def drop_file(lake, tenant, name, text):
    import pathlib

    path = pathlib.Path(lake.raw_folder(tenant)) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return f"tenants/{tenant}/raw/{name}"


def run(spark, lake, uploads, tmp_path, mode="by_name"):
    schema = "raw_file_path string, tenant_id string, table_name string, format string"
    query = ingest.start_ingest(lake, lambda: spark.createDataFrame(uploads, schema), str(tmp_path / "checkpoint"), mode)
    query.awaitTermination()


def outcomes(lake):
    """File name -> its states and rows, pending ones included."""
    found = {}
    for r in ingest.job_events(lake).collect():
        found.setdefault(r.path.rsplit("/", 1)[1], set()).add((r.status, r.row_count))
    return found


def test_files_arrive_once_and_bad_ones_stand_aside(spark, lake, tmp_path):
    uploads = [
        (drop_file(lake, T, "1_a.csv", "Id,Name\n1,a\n2,b\n"), T, "people", "csv"),
        (drop_file(lake, "tenant_b", "1_b.json", '{"Id": 7}\n{"Id": 8}\n'), "tenant_b", "people", "json"),
    ]
    drop_file(lake, T, "1_unregistered.csv", "Id,Name\n9,z\n")
    run(spark, lake, uploads, tmp_path)
    run(spark, lake, uploads, tmp_path)
    assert sorted(r.id for r in lake.read(T, "people").collect()) == [1, 2]
    assert sorted(r.id for r in lake.read("tenant_b", "people").collect()) == [7, 8]

    uploads += [
        (drop_file(lake, T, "2_good.csv", "Id,Name\n3,c\n"), T, "people", "csv"),
        (drop_file(lake, T, "2_bad.csv", "Id,Name\n4,d\nfive,e\n"), T, "people", "csv"),
    ]
    run(spark, lake, uploads, tmp_path)
    assert sorted(r.id for r in lake.read(T, "people").collect()) == [1, 2, 3]
    assert lake.read(T, "people").columns == ["id", "name"]
    assert sorted(r.id for r in spark.table(f"{T}_people").collect()) == [1, 2, 3]
    events = {r.path.rsplit("/", 1)[1]: r for r in ingest.job_events(lake).collect()}
    assert {k: (v.status, v.row_count) for k, v in events.items()} == {
        "1_a.csv": ("completed", 2), "1_b.json": ("completed", 2), "2_good.csv": ("completed", 1),
        "2_bad.csv": ("failed", 0), "1_unregistered.csv": ("pending", 0)}
    assert "five,e" in events["2_bad.csv"].error
    assert [r.line for r in ingest.quarantined(lake, T, "people").collect()] == ["five,e"]


def test_unreadable_file_does_not_stop_its_group(spark, lake, tmp_path):
    uploads = [
        (drop_file(lake, T, "1_x.parquet", "this is not parquet"), T, "facts", "parquet"),
        (drop_file(lake, T, "1_y.csv", "a\n1\n"), T, "rows", "csv"),
    ]
    spark.range(4).coalesce(1).write.parquet(f"{lake.raw_folder(T)}/2_ok.parquet")
    uploads.append((f"tenants/{T}/raw/2_ok.parquet", T, "facts", "parquet"))
    run(spark, lake, uploads, tmp_path)
    assert lake.read(T, "facts").count() == 4
    assert lake.read(T, "rows").count() == 1
    failed = ingest.job_events(lake).filter("status = 'failed'").collect()
    assert len(failed) == 1 and failed[0].path.endswith("1_x.parquet") and failed[0].error


def test_repeated_micro_batch_adds_nothing(spark, lake):
    key = drop_file(lake, T, "1_a.csv", "a\n1\n2\n")
    uploads = spark.createDataFrame(
        [(key, T, "t", "csv")], "raw_file_path string, tenant_id string, table_name string, format string")
    files = spark.createDataFrame([(f"file:{lake.root}/{key}",)], "path string")
    for _ in range(2):
        ingest.ingest_batch(lake, uploads, files, 5)
    assert lake.read(T, "t").count() == 2
    assert ingest.job_events(lake).count() == 1


def test_csv_columns_meet_by_name(spark, lake, tmp_path):
    up = [(drop_file(lake, T, "1.csv", "Name,City\nann,rome\n"), T, "people", "csv")]
    run(spark, lake, up, tmp_path)
    up += [(drop_file(lake, T, "2 b%20 c.csv", 'City,Name\noslo,"bob\nby"\n'), T, "people", "csv"),
           (drop_file(lake, T, "3.csv", "City,Age\nbonn,5\n"), T, "people", "csv"),
           (drop_file(lake, T, "4.csv", "Name,City\n"), T, "people", "csv"),
           (drop_file(lake, T, "5.csv", "Name,City\n\"  cy \",bern\n"), T, "people", "csv")]
    os.utime(f"{lake.root}/{up[1][0]}", (1e9, 1e9))  # copied with an old time
    run(spark, lake, up, tmp_path)
    assert sorted(map(tuple, lake.read(T, "people").collect())) == [
        ("  cy ", "bern"), ("ann", "rome"), ("bob\nby", "oslo")]
    assert outcomes(lake) == {"1.csv": {("completed", 1)}, "2 b%20 c.csv": {("completed", 1)}, "3.csv": {("failed", 0)},
                              "4.csv": {("completed", 0)}, "5.csv": {("completed", 1)}}


def test_json_keys_types_and_bad_lines(spark, lake, tmp_path):
    up = [(drop_file(lake, T, "1.json", '{"Order ID": 1, "At": "2024-01-02"}\n'), T, "orders", "json")]
    run(spark, lake, up, tmp_path)
    up += [(drop_file(lake, T, "2.json", '[{"Order ID": 2, "At": "2024-01-03"},\n {"Order ID": 3}]'), T, "orders", "json"),
           (drop_file(lake, T, "3.json", '{"Order ID": 4}\n{"Order ID": 5}\n'), T, "orders", "json"),
           (drop_file(lake, T, "4.json", '{"Order ID": 6}\n{"Order ID": oops\n'), T, "orders", "json"),
           (drop_file(lake, T, "5.json", '{"Order ID": "seven"}\n'), T, "orders", "json")]
    run(spark, lake, up, tmp_path)
    assert sorted((r.order_id, str(r["at"])) for r in lake.read(T, "orders").collect()) == [
        (1, "2024-01-02"), (2, "2024-01-03"), (3, "None"), (4, "None"), (5, "None")]
    assert outcomes(lake) == {"1.json": {("completed", 1)}, "2.json": {("completed", 2)}, "3.json": {("completed", 2)},
                              "4.json": {("failed", 0)}, "5.json": {("failed", 0)}}
    assert {"oops" in r.line or "seven" in r.line for r in ingest.quarantined(lake, T, "orders").collect()} == {True}


def test_late_registration_and_evolution(spark, lake, tmp_path):
    early = drop_file(lake, T, "1.csv", "Id\n1\n")
    run(spark, lake, [], tmp_path)
    assert [r.path.rsplit("/", 1)[1] for r in ingest.pending_files(lake).collect()] == ["1.csv"]
    up = [(early, T, "things", "csv")]
    for _ in range(2):  # no new file has come, and nothing arrives twice
        run(spark, lake, up, tmp_path, "evolve")
    assert [r.id for r in lake.read(T, "things").collect()] == [1] and ingest.pending_files(lake).count() == 0
    up += [(drop_file(lake, T, "2.csv", "Extra,Id\nx,2\n"), T, "things", "csv"),
           (drop_file(lake, T, "3.json", '{"ID": 3, "more": 1.5}\n'), T, "things", "json")]
    run(spark, lake, up, tmp_path, "evolve")
    assert sorted(map(str, (r.asDict() for r in lake.read(T, "things").collect()))) == sorted(map(str, [
        {"id": 1, "extra": None, "more": None}, {"id": 2, "extra": "x", "more": None}, {"id": 3, "extra": None, "more": 1.5}]))


def test_failing_catalog_does_not_repeat_rows(spark, lake, tmp_path, monkeypatch):
    def broken(*args, **kwargs):
        raise RuntimeError("no catalog")

    monkeypatch.setattr(type(lake), "publish", broken)
    up = [(drop_file(lake, T, f"{i}.csv", f"Id\n{i}\n"), T, "things", "csv") for i in range(3)]
    run(spark, lake, up, tmp_path)
    assert sorted(r.id for r in lake.read(T, "things").collect()) == [0, 1, 2]


def parquet(spark, lake, tenant, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{lake.raw_folder(tenant)}/{name}")
    return f"tenants/{tenant}/raw/{name}"


def mixed(spark, lake):
    return [(parquet(spark, lake, T, "1", [(1, "x1")], "Id long, X string"), T, "facts", "parquet"),
            (parquet(spark, lake, T, "2", [(2, "y2")], "Id long, Y string"), T, "facts", "parquet"),
            (parquet(spark, lake, T, "3", [("x3", 3)], "x string, id int"), T, "facts", "parquet"),
            (parquet(spark, lake, T, "4", [(4, "x4")], "Id long, X string"), T, "facts", "parquet")]


def test_parquet_files_of_differing_columns_in_one_batch_keep_them_all(spark, lake, tmp_path):
    run(spark, lake, mixed(spark, lake), tmp_path, "evolve")
    assert sorted(map(str, (r.asDict() for r in lake.read(T, "facts").collect()))) == sorted(map(str, [
        {"id": 1, "x": "x1", "y": None}, {"id": 2, "x": None, "y": "y2"}, {"id": 3, "x": "x3", "y": None},
        {"id": 4, "x": "x4", "y": None}]))


def test_strict_mode_fails_the_odd_files_whatever_shares_a_batch(spark, lake, tmp_path):
    up = mixed(spark, lake)
    run(spark, lake, up, tmp_path)
    assert sorted(map(tuple, lake.read(T, "facts").collect())) == [(1, "x1"), (3, "x3"), (4, "x4")]
    events = {r.path.split("/raw/")[1][0]: r.status for r in ingest.job_events(lake).collect()}
    assert events == {"1": "completed", "2": "failed", "3": "completed", "4": "completed"}
    for table, together in (("one", True), ("two", False)):
        files = [(drop_file(lake, T, f"{table}1.json", '{"a": 1}\n'), T, table, "json"),
                 (drop_file(lake, T, f"{table}2.json", '[{"a": 2, "b": 3}]'), T, table, "json")]
        for some in [files] if together else [files[:1], files]:
            up = up + [f for f in some if f not in up]
            run(spark, lake, up, tmp_path)
        assert lake.read(T, table).columns == ["a"] and lake.read(T, table).count() == 1


def test_shapes_of_all_formats(spark, tmp_path):
    from silverbrook.sources.shapes import shapes

    texts = {"a.csv": '"A, b",C\n1,2\n', "b.csv": "", "c.json": ' \n[{"b": 1}, {"a": {"z": 1}}]', "d.json": '{"x": 1}\nbad\n{"y": 2}',
             "e.json": "", "f.parquet": "no parquet", "g h%20.csv": "Q\n1\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    files = {f"file:{tmp_path}/{n}": n.rsplit(".", 1)[1] for n in texts}
    got = {p.rsplit("/", 1)[1]: v for p, v in shapes(spark, [*files.items(), ("nowhere://x/y.csv", "csv")]).items()}
    assert got.pop("f.parquet")[1].startswith("unreadable") and got.pop("y.csv")[1].startswith("unreadable")
    assert got == {"a.csv": ("csv", '["A, b", "C"]'), "b.csv": ("csv", "[]"), "c.json": ("array", '["a","b"]'),
                   "d.json": ("lines", '["x","y"]'), "e.json": ("lines", "[]"), "g h%20.csv": ("csv", '["Q"]')}


def test_many_waiting_files_arrive_in_bounded_steps(spark, lake, tmp_path, monkeypatch):
    keys = [drop_file(lake, T, f"{i:03}.csv", f"Id\n{i}\n") for i in range(25)]
    run(spark, lake, [], tmp_path)
    assert ingest.pending_files(lake).count() == 25
    up = spark.createDataFrame([(k, T, "things", "csv") for k in keys[:23]],
                               "raw_file_path string, tenant_id string, table_name string, format string")
    assert ingest.retry_pending(lake, up, max_files=10) == 10 and ingest.pending_files(lake).count() == 15
    events, cut = ingest._events, RuntimeError("executor lost")

    def broken(*args):
        raise cut

    monkeypatch.setattr(ingest, "_events", broken)  # cut short after the commit
    try:
        ingest.retry_pending(lake, up, max_files=10)
    except RuntimeError as error:
        assert error is cut
    monkeypatch.setattr(ingest, "_events", events)
    assert [ingest.retry_pending(lake, up, max_files=n) for n in (4, 10, 10)] == [10, 3, 0]
    assert sorted(r.id for r in lake.read(T, "things").collect()) == list(range(23))
    assert ingest.pending_files(lake).count() == 2
    # a long list stays a table: only what is registered comes to the driver
    spark.range(100_000).selectExpr("concat('file:/none/', id) AS path").write.json(f"{lake.root}/registry/pending/x")
    assert ingest.retry_pending(lake, up) == 0 and ingest.pending_files(lake).count() == 100_002
