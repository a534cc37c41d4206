"""Every registered query against its SQL on the smallest data set."""

import os

import pytest
from compare import DATA, compare

from silverbrook.plans.catalogue import ORACLES, QUERIES

FOLDER = f"{DATA}/sf0.001"


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    status, detail = compare(spark, FOLDER, name)
    assert status == ("match" if name in ORACLES else "rows-only"), detail
    assert "types differ" not in detail, detail


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.queries()) >= set(QUERIES)
