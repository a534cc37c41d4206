"""Headline timings: one JSON line with seconds per query.

Every query runs once to warm up and once timed; the timed run computes all rows and
columns and discards them. ``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the threads;
query names on the command line replace the headline list.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from silverbrook.plans.catalogue import QUERIES  # noqa: E402
from silverbrook.session import build_session  # noqa: E402

HEADLINES = [
    "sql_groupby", "sql_run", "sql_join_inner", "sql_join_left", "sql_having", "sql_topk", "sql_rank", "sql_running",
    "sql_lag", "sql_asof", "sql_range_join", "sql_count_distinct", "sql_rollup", "sql_quantile", "sql_correlated",
    "src_csv", "src_parquet", "src_ndjson", "snk_append", "gold_materialize", "str_ingest",
    "cat_live_tables", "cat_list_tables", "cat_dataset_counts", "cat_latest_status", "cat_illegal_transitions",
    "cat_upsert", "sch_infer_csv", "sch_infer_json", "sch_match_ranked", "sch_names_final",
    "pol_audit", "pol_lint", "lin_edges", "lin_dependents", "lin_missing", "prj_clean_names", "exp_csv",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.silverbrook.rowPartitions": cpus,  # the tables are single small files
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="bench-warehouse-"),
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
