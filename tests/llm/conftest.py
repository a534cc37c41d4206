import os

import pytest

DATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def small():
    folder = f"{DATA}/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("driver tables not present")
    return folder


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make
