"""The commit log over many commits: checkpoints, racing writers, vacuum, publishing."""

import os

import pytest

from silverbrook.operators import tables

T = "tenant_acme"


def rows_of(lake, table="t", **options):
    return sorted(r.id for r in lake.read(T, table, **options).collect())


def fill(spark, lake, n, start=0):
    for i in range(start, start + n):
        lake.commit(T, "t", spark.range(i, i + 1), batch_id=f"b{i}")


def test_reading_the_log_does_not_grow_with_its_length(spark, lake, monkeypatch):
    monkeypatch.setattr(tables, "CHECKPOINT_EVERY", 5)
    fill(spark, lake, 4)
    short = len(lake.history(T, "t").inputFiles())
    fill(spark, lake, 19, 4)
    log = lake.history(T, "t")
    assert len(log.inputFiles()) <= 2 * short
    assert [r.total_rows for r in log.orderBy("snapshot_id").collect()] == list(range(1, 24))
    assert lake.commits().count() == 23
    again = lake.commit(T, "t", spark.range(9), batch_id="b3")  # long before the checkpoint
    assert (again.snapshot_id, again.batch_rows, again.total_rows) == (4, 1, 23)
    assert rows_of(lake) == list(range(23)) and rows_of(lake, as_of=7) == list(range(7))
    lake.vacuum(T, "t", hidden_hours=0)
    segments = [n for n in os.listdir(f"{lake.root}/registry/commits/{T}/silver/t") if n.isdigit()]
    assert [int(n) for n in segments] == [4] and lake.history(T, "t").count() == 23 and rows_of(lake) == list(range(23))
    fill(spark, lake, 3, 23)
    assert rows_of(lake) == list(range(26)) == sorted(r.id for r in spark.table(f"{T}_t").collect())
    assert lake.publish_all() and spark.table(f"{T}_t").count() == 26


def test_a_writer_overtaken_by_a_checkpoint_logs_again(spark, lake, monkeypatch):
    monkeypatch.setattr(tables, "CHECKPOINT_EVERY", 3)
    fill(spark, lake, 2)
    claim, met = lake._claim_snapshot, []

    def slow(tenant, table, layer, last):
        number = claim(tenant, table, layer, last)
        if not met:  # others go past while this one sleeps, and write a checkpoint without it
            met.append(number)
            fill(spark, lake, 3, 10)
        return number

    monkeypatch.setattr(lake, "_claim_snapshot", slow)
    done = lake.commit(T, "t", spark.range(5, 6), batch_id="slow")
    assert met == [3] and done.snapshot_id == 7 and done.total_rows == 6
    assert rows_of(lake) == [0, 1, 5, 10, 11, 12] and lake.history(T, "t").count() == 6


def test_of_two_rows_of_a_batch_the_first_counts(spark, lake):
    fill(spark, lake, 2)
    log = lake.history(T, "t").where("snapshot_id = 1").withColumn("snapshot_id", tables.F.lit(9).cast("long"))
    log.write.json(f"{lake.root}/registry/commits/{T}/silver/t/0000000000/copy")
    assert [r.snapshot_id for r in lake.history(T, "t").orderBy("snapshot_id").collect()] == [1, 2]


def test_vacuum_keeps_what_retained_snapshots_show(spark, lake):
    fill(spark, lake, 2)
    lake.commit(T, "t", spark.range(50, 52), batch_id="r", replace=True)
    fill(spark, lake, 1, 3)
    lake.commit(T, "t", spark.range(3), batch_id="half", publish=False)
    assert lake.vacuum(T, "t", oldest=2).count() == 0  # a young folder may belong to a writer at work
    assert rows_of(lake, as_of=2) == [0, 1]
    gone = {(r.batch_id, r.reason) for r in lake.vacuum(T, "t", oldest=3, hidden_hours=0).collect()}
    assert gone == {("b0", "replaced"), ("b1", "replaced"), ("half", "hidden")}
    assert lake.vacuum(T, "t", oldest=3, hidden_hours=0).count() == 0
    assert rows_of(lake) == [3, 50, 51] and rows_of(lake, as_of=3) == [50, 51]
    with pytest.raises(LookupError):
        lake.read(T, "t", as_of=2)
    assert sorted(os.listdir(lake.table_folder(T, "t"))) == ["batch_id=b3", "batch_id=r"]


def test_publishing_many_batches_is_one_statement(spark, lake, monkeypatch):
    fill(spark, lake, 1)
    log = lake.history(T, "t")
    many = log.crossJoin(spark.range(1, 3000)).select(
        *[c for c in log.columns if c not in ("batch_id", "snapshot_id")],
        tables.F.expr("concat('x', id)").alias("batch_id"), (tables.F.col("id") + 1).alias("snapshot_id"))
    many.coalesce(1).write.json(f"{lake.root}/registry/commits/{T}/silver/t/0000000000/many")
    statements, run = [], spark.sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, **k: statements.append(text) or run(text, **k))
    lake.publish(T, "t")
    assert sum(s.startswith("ALTER TABLE") for s in statements) == 1
    monkeypatch.undo()
    assert spark.sql(f"SHOW PARTITIONS `{T}_silver`.`t__batches`").count() == 3000
