import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from silverbrook.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[*]", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="warehouse-"),
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="shared-"),
    })
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def lake(spark, tmp_path):
    from silverbrook.operators.tables import Lake

    for db in spark.catalog.listDatabases():
        if db.name != "default":
            spark.sql(f"DROP SCHEMA `{db.name}` CASCADE")
    for t in spark.catalog.listTables("default"):
        spark.sql(f"DROP VIEW IF EXISTS `{t.name}`")
    return Lake(spark, str(tmp_path / "lake"))
