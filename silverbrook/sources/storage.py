"""Discovery of tenants and tables from the names of stored files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SAFE_NAME = re.compile(r"^[A-Za-z0-9_-]+$")


def safe_name(name: str) -> str:
    """A tenant, layer or table name that may become a path segment or SQL identifier."""
    if not _SAFE_NAME.match(name or ""):
        raise ValueError(f"unsafe name: {name!r}")
    return name


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _filesystem(spark, path)
    return fs.exists(hadoop_path)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders directly below a folder; none if it does not exist."""
    fs, hadoop_path = _filesystem(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(hadoop_path)] if fs.exists(hadoop_path) else []


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file at or below a path; patterns and missing paths have none."""
    fs, hadoop_path = _filesystem(spark, path)
    if not fs.exists(hadoop_path):
        return 0
    files, most = fs.listFiles(hadoop_path, True), 0
    while files.hasNext():
        most = max(most, files.next().getLen())
    return most


def files_below(spark: SparkSession, path: str) -> list[str]:
    """Data files at or below a path, in order of name; hidden ones and empty ones are left out."""
    fs, hadoop_path = _filesystem(spark, path)
    files, found = fs.listFiles(hadoop_path, True), []
    base = fs.makeQualified(hadoop_path).toString()
    while files.hasNext():
        status = files.next()
        name = status.getPath().toString()
        if status.getLen() and not re.search(r"/[._][^/]*", name.removeprefix(base)):
            found.append(name)
    return sorted(found)


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Remove exactly one folder; false when it was not there."""
    fs, hadoop_path = _filesystem(spark, path)
    return fs.delete(hadoop_path, True)


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless it exists; of several callers one gets true.

    Needs a store whose create-without-overwrite is atomic, as HDFS has.
    """
    fs, hadoop_path = _filesystem(spark, path)
    if fs.exists(hadoop_path):
        return False
    try:
        fs.create(hadoop_path, False).close()
    except Exception as error:  # noqa: BLE001
        if fs.exists(hadoop_path):
            return False
        raise error
    return True


# Storage folder of a tenant and the layer it holds.
LAYER_FOLDERS = {"tables": "silver", "gold": "gold"}


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per stored file: path relative to ``root``, size and modification time.

    The listing runs on Spark's file index; file contents are not read.
    """
    base = root.rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
        .select("path", "length", F.col("modificationTime").alias("modified_at"))
    )
    at = F.instr(F.col("path"), base) + len(base) + 1
    return files.withColumn("path", F.substr("path", at))


def tenants_in(files: DataFrame) -> DataFrame:
    """Distinct tenants that own at least one file, sorted."""
    parts = F.split(F.col("path"), "/")
    return (
        files.filter(F.startswith("path", F.lit("tenants/")) & (F.size(parts) >= 3) & (F.get(parts, F.lit(1)) != ""))
        .select(F.get(parts, F.lit(1)).alias("tenant_id"))
        .distinct()
        .orderBy("tenant_id")
    )


def tables_in(files: DataFrame) -> DataFrame:
    """Tables that hold at least one Parquet file, with file count and bytes."""
    parts = F.split(F.col("path"), "/")
    folders = F.create_map(*[F.lit(x) for pair in LAYER_FOLDERS.items() for x in pair])
    return (
        files.filter(F.startswith("path", F.lit("tenants/")) & (F.size(parts) >= 5))
        .select(
            F.get(parts, F.lit(1)).alias("tenant_id"),
            F.try_element_at(folders, F.get(parts, F.lit(2))).alias("layer"),
            F.get(parts, F.lit(3)).alias("table_name"),
            F.col("path").endswith(".parquet").alias("is_parquet"),
            "length",
        )
        .filter(F.col("layer").isNotNull())
        .groupBy("tenant_id", "layer", "table_name")
        .agg(
            F.count_if("is_parquet").alias("n_files"),
            F.sum(F.when(F.col("is_parquet"), F.col("length"))).alias("n_bytes"),
        )
        .filter(F.col("n_files") > 0)
    )


def register_tables(spark: SparkSession, root: str, tables: DataFrame) -> list[str]:
    """Create a view per discovered table and the flat alias of Silver tables.

    Iterates over catalog entries on the driver: one statement per table, no data.
    """
    names = []
    folder = {layer: name for name, layer in LAYER_FOLDERS.items()}
    for t in tables.select("tenant_id", "layer", "table_name").toLocalIterator():
        if not all(_SAFE_NAME.match(n) for n in (t.tenant_id, t.table_name)):
            continue
        path = f"{root.rstrip('/')}/tenants/{t.tenant_id}/{folder[t.layer]}/{t.table_name}"
        schema = f"{t.tenant_id}_{t.layer}"
        name = f"{schema}.{t.table_name}"
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
        spark.sql(f"DROP VIEW IF EXISTS `{schema}`.`{t.table_name}`")
        base = f"`{schema}`.`{t.table_name}__files`"
        spark.sql(f"DROP TABLE IF EXISTS {base}")
        spark.sql(f"CREATE TABLE {base} USING parquet OPTIONS (path '{path}', mergeSchema 'true')")
        spark.sql(f"CREATE VIEW `{schema}`.`{t.table_name}` AS SELECT * FROM {base}")
        names.append(name)
        if t.layer == "silver":
            spark.sql(f"CREATE OR REPLACE VIEW `{t.tenant_id}_{t.table_name}` AS "
                      f"SELECT * FROM `{schema}`.`{t.table_name}`")
    return names
