"""Side-by-side run of a registered query and its SQL in an embedded checking engine.

``python tests/compare.py [scale [name ...]]`` checks all or some queries at a scale.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from silverbrook.plans.catalogue import ORACLES, QUERIES  # noqa: E402
from silverbrook.plans.registry import TABLES  # noqa: E402

DATA = os.environ.get("TESTDATA", "/root/testdata")


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    """One comparable form per value; exact for floats."""
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return f"d{value.normalize()}"
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return repr(value)


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


_TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def compare(spark, folder: str, name: str) -> tuple[str, str]:
    """(status, detail): ``match``, ``rows-only`` or ``mismatch``."""
    df = QUERIES[name](spark, folder)
    columns, rows = normalised(df.columns, df.collect())
    if name not in ORACLES:
        return "rows-only", f"{len(rows)} rows"
    con = oracle_connection(folder)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want_columns, want = normalised(names, result.fetchall())
    if columns != want_columns:
        return "mismatch", f"columns {columns} != {want_columns}"
    if rows != want:
        extra, lack = set(rows) - set(want), set(want) - set(rows)
        return "mismatch", (f"{len(rows)} vs {len(want)} rows; only here {len(extra)}: {sorted(extra)[:2]}; "
                            f"only there {len(lack)}: {sorted(lack)[:2]}")
    notes = [
        f"{f.name}:{f.dataType.simpleString()}/{types[f.name]}" for f in df.schema.fields
        if _TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString()) != types[f.name]
    ]
    return "match", f"{len(rows)} rows" + (f"  types differ: {notes}" if notes else "")


def main() -> int:
    from silverbrook.session import build_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.sql.warehouse.dir": f"/tmp/warehouse-{os.getpid()}"})
    spark.sparkContext.setLogLevel("OFF")
    failed = 0
    for name in names:
        start = time.time()
        try:
            status, detail = compare(spark, f"{DATA}/sf{scale}", name)
        except Exception as error:  # noqa: BLE001
            status, detail = "error", str(error)[:1500]
        failed += status in ("mismatch", "error")
        print(f"{status:10} {name:26} {time.time() - start:6.1f}s  {detail}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
