"""Session and scratch-space helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "silverbrook", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the toolkit expects.

    Everything here is a default: cluster-level settings passed by spark-submit win,
    because only unset keys are filled in by ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``; a local session that leaves the
    setting empty gets a fresh temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="silverbrook-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call will be given."""
    return os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")


# Session setting that names the number of partitions for CPU-heavy row work.
ROW_PARTITIONS = "spark.silverbrook.rowPartitions"


# Rows of a task that holds them all in tables of groups.
ROWS_A_TASK = 250_000


def spread(df: DataFrame) -> DataFrame:
    """Redistribute CPU-heavy row work if the session asks for a number of partitions.

    Only the setting decides, never the size of the input: inputs of a few small files gain
    from it, all others are best left as they are read.
    """
    wanted = df.sparkSession.conf.get(ROW_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df


def together(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` with the rows of a key in one partition; the number of partitions grows with ``rows``, so tasks do not.

    Adaptive execution merges partitions by their compressed size, which leaves millions of small rows in a task.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, rows // ROWS_A_TASK + 1), *keys)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    For results used several times: later steps scan stored columns instead of repeating
    the work, and a lost executor costs no recomputation.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def each(df: DataFrame, array: Column, name: str, *keep: str | Column) -> DataFrame:
    """``keep`` columns with one row per non-null element of ``array``, computed once.

    A plain explode or filter lets the optimizer copy the expression into a filter below,
    which doubles the cost of regular expressions; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
