"""One large CSV file in many tasks gives what one task gives."""

import random

import pytest

from silverbrook.sources import csv_split, readers


@pytest.fixture
def blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield size
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cell(rng):
    kind = rng.randrange(7)
    if kind == 0:
        return '"' + rng.choice(['a\nb', 'x,""y""\n\n', '\n', '""', '"",\n""', "\r\n", "long\n" * 40]) + '"'
    return rng.choice(["", "plain", 'mid"quote', "5", '"quoted"', " spaced "]) if kind < 4 else str(rng.randrange(1000))


def test_many_blocks_equal_one_task(spark, blocks, tmp_path):
    rng = random.Random(7)
    for n, eol in ((1, "\n"), (2, "\r\n")):
        body = eol.join(f"{i},{cell(rng)},{cell(rng)}" for i in range(300))
        (tmp_path / f"{n}.csv").write_bytes(f'Id,"No{eol}te",Text{eol}{body}{eol if n == 1 else ""}'.encode())
    for n in (1, 2):
        path = f"{tmp_path}/{n}.csv"
        one = readers.read_csv(spark, path, multi_line=True)
        want = sorted(map(tuple, one.collect()))
        for size in (150, 3000):
            blocks(size)
            many = readers.read_csv(spark, path, file_column="src")
            assert many.columns == [*one.columns, "src"]
            assert sorted(tuple(r)[:-1] for r in many.collect()) == want
            assert {r.src.rsplit("/", 1)[1] for r in many.collect()} == {f"{n}.csv"}
        assert csv_split.block_states(spark, [path]).count() > 1


def test_files_without_breaks_are_read_as_lines(spark, blocks, tmp_path):
    (tmp_path / "a.csv").write_text("Id,Name\n" + "".join(f'{i},"n, {i}"\n' for i in range(500)))
    blocks(200)
    df = readers.read_csv(spark, f"{tmp_path}/a.csv")
    assert df.rdd.getNumPartitions() > 8
    assert sorted(map(tuple, df.collect())) == [(i, f"n, {i}") for i in range(500)]


def test_bad_records_keep_their_text(spark, blocks, tmp_path):
    (tmp_path / "a.csv").write_text('Id,Name\n1,"a\nb"\nx,"c\nd"\n3,e\n')
    schema = readers.T.StructType().add("id", "long").add("name", "string")
    blocks(9)
    got = readers.read_csv(spark, f"{tmp_path}/a.csv", schema=schema, corrupt_column="bad").collect()
    assert sorted((r.id or 0, r.name, r.bad) for r in got) == [(0, "c\nd", 'x,"c\nd"'), (1, "a\nb", None), (3, "e", None)]


def test_states_of_a_line():
    ends = csv_split.ends_inside
    assert [ends(x, False) for x in ("", "a", '"a', '"a"', '"a""', 'a"b', '"a","b', '"a""b",c')] == [
        False, False, True, False, True, False, True, False]
    assert [ends(x, True) for x in ("", "a", 'a"', 'a""', 'a"",', 'a","b', 'a",b', '"')] == [
        True, True, False, True, True, True, False, False]


def test_blocks_grow_with_the_files():
    from silverbrook.plans.q_sources import block_bytes

    assert block_bytes(1 << 20, 128 << 20) == 128 << 10
    for size in (1 << 28, 1 << 31, 1 << 33):
        assert size / block_bytes(size, 128 << 20) < 102
    assert block_bytes(1 << 40, 128 << 20) == 128 << 20
