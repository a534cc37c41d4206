"""Continuous ingestion of raw files into Silver tables.

A file stream announces new raw files; each micro-batch resolves them against the upload
registry and appends their rows to the tables they belong to. The stream checkpoint makes
every file arrive once, and the batch id makes a repeated micro-batch overwrite its own
output instead of adding to it. A file whose registry row is not there yet waits in a
pending table, which is joined with the registry again and again; every file ends up
completed, failed or pending.

Files are read together only if they have the same columns, so neither a column nor a
mismatch goes unseen because of what else is in the batch. The shapes of all files of a
batch are found by one job; groups go in the order of their first file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from silverbrook.operators.tables import BatchRejected, Lake
from silverbrook.sources import readers
from silverbrook.sources.shapes import plain_path, shapes
from silverbrook.sources.storage import delete_folder, path_exists

CORRUPT, SOURCE = "_corrupt_line", "_source_file"

FILE_SCHEMA = (
    T.StructType().add("path", "string").add("modificationTime", "timestamp").add("length", "long")
    .add("content", "binary")
)

EVENT_SCHEMA = (
    T.StructType().add("tenant_id", "string").add("table_name", "string").add("path", "string")
    .add("status", "string").add("row_count", "long").add("batch_id", "string").add("error", "string")
)


def land(df: DataFrame, lake: Lake, tenant: str, name: str, fmt: str = "csv", **options) -> str:
    """Write a DataFrame as raw upload ``tenants/{tenant}/raw/{name}`` in any text format."""
    path = f"{lake.raw_folder(tenant)}/{name}"
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False} if fmt == "csv" else {}
    df.write.format(fmt).options(**{**blanks, **options}).save(path)
    return path


def raw_files(spark: SparkSession, lake: Lake, max_files: int = 1000) -> DataFrame:
    """Stream of raw files; only names and times are read, never contents."""
    return (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files)
        .option("maxFileAge", "36500d")  # a copied file may carry any old time
        .load(f"{lake.root}/tenants/*/raw")
        .select("path", "modificationTime")
    )


def _events(lake: Lake, rows: list[tuple], batch_id: str) -> None:
    if rows:
        lake.spark.createDataFrame(rows, EVENT_SCHEMA).withColumn("at", F.current_timestamp()).coalesce(1).write.mode(
            "overwrite").json(f"{lake.root}/registry/job_events/{batch_id}")


def job_events(lake: Lake) -> DataFrame:
    """Outcome of every ingested file."""
    schema = T.StructType(EVENT_SCHEMA.fields + [T.StructField("at", T.TimestampType())])
    return lake.spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{lake.root}/registry/job_events")


def quarantined(lake: Lake, tenant: str, table: str) -> DataFrame:
    """Lines of failed files, kept as text with the file they came from."""
    return lake.spark.read.parquet(f"{lake.root}/tenants/{tenant}/quarantine/{table}")


def _read_group(lake: Lake, tenant: str, table: str, fmt: str, paths: list[str]) -> DataFrame:
    """Rows of one group with their file; lines that do not fit carry their raw text.

    ``fmt`` is csv, parquet, array or lines, and all files have the same columns.
    """
    spark, schema = lake.spark, lake.schema_of(tenant, table)
    if fmt == "csv":
        return readers.read_csv(spark, paths, schema=schema, corrupt_column=CORRUPT, file_column=SOURCE)
    if fmt == "parquet":
        df = readers.read_parquet(spark, paths).withColumn(CORRUPT, F.lit(None).cast("string"))
    else:
        df = readers.read_json(spark, paths, schema=schema, corrupt_column=CORRUPT, array=fmt == "array")
    return df.withColumn(SOURCE, F.input_file_name())


def _ingest_group(lake: Lake, tenant: str, table: str, fmt: str, paths: list[str], batch_id: str,
                  mode: str) -> list[tuple]:
    """Append one group of files; files with an unreadable line are set aside whole.

    The raw text is parsed once: the batch is written with the file name and the text of
    unreadable lines beside the data, then judged on those two columns. Only if a file
    fails is the batch written again without it. A file without rows is completed with none.
    """
    listed = {plain_path(p): p for p in paths}
    tally: dict[str, tuple] = dict.fromkeys(paths, (0, 0, None))

    def accept(written: DataFrame) -> bool:
        per_file = written.groupBy(SOURCE).agg(
            F.count(F.lit(1)).alias("n"), F.count(CORRUPT).alias("bad"), F.min(CORRUPT).alias("example"))
        tally.update({listed[plain_path(unquote(r[SOURCE]))]: (r["n"], r["bad"], r["example"]) for r in per_file.collect()})
        failed = [path for path, (_, bad, _) in tally.items() if bad]
        if failed:
            written.filter(F.col(CORRUPT).isNotNull()).select(F.col(SOURCE).alias("path"), F.col(CORRUPT).alias("line")) \
                .write.mode("overwrite").parquet(
                    f"{lake.root}/tenants/{tenant}/quarantine/{table}/batch_id={batch_id}")
        return not failed

    rows = _read_group(lake, tenant, table, fmt, paths)
    options = {"batch_id": batch_id, "mode": mode, "hidden": (SOURCE, CORRUPT)}
    try:
        lake.commit(tenant, table, rows, audit=accept, **options)
    except BatchRejected:
        good = sorted(path for path, (_, bad, _) in tally.items() if not bad)
        if good:
            lake.commit(tenant, table, _read_group(lake, tenant, table, fmt, good), **options)
    return [
        (tenant, table, path, "failed" if bad else "completed", 0 if bad else n, batch_id,
         f"line does not fit the table: {example}" if bad else None)
        for path, (n, bad, example) in tally.items()
    ]


def _file_tag(path: str) -> str:
    return hashlib.sha1(plain_path(path).encode()).hexdigest()[:16]


def _one_by_one(lake: Lake, tenant: str, table: str, fmt: str, paths: list[str], tag: str, mode: str) -> list[tuple]:
    """File by file, each under an id of its own that a repetition finds again."""
    outcome = []
    for path in sorted(paths):
        own = f"{tag}-{_file_tag(path)}"
        try:
            outcome += _ingest_group(lake, tenant, table, fmt, [path], own, mode)
        except Exception as error:  # noqa: BLE001  one bad file must not hold up the others
            outcome.append((tenant, table, path, "failed", 0, own, str(error).splitlines()[0]))
    return outcome


Group = tuple[str, str, list[str]]


def _ingest_target(lake: Lake, tenant: str, table: str, groups: list[Group], batch: str, mode: str) -> list[tuple]:
    """All groups of one table, one after another, because the first may fix its schema."""
    outcome = []
    for kind, shape, paths in groups:
        tag = f"{batch}-{kind}-{hashlib.sha1(shape.encode()).hexdigest()[:8]}"
        if lake.batch_ids(tenant, table, f"{tag}-"):  # an earlier attempt went file by file
            outcome += _one_by_one(lake, tenant, table, kind, paths, tag, mode)
            continue
        try:
            outcome += _ingest_group(lake, tenant, table, kind, paths, tag, mode)
        except Exception:  # noqa: BLE001
            if lake.batch_ids(tenant, table, tag):
                raise  # committed already: a repetition finds it done
            outcome += _one_by_one(lake, tenant, table, kind, paths, tag, mode)
    return outcome


# Targets that are ingested at the same time; each is a Spark job of its own.
PARALLEL_TARGETS = 8


def _ingest_files(lake: Lake, files: list[Row], tag: str, mode: str) -> list[tuple]:
    """Ingest registered files: read by shape, tables side by side."""
    formats = {f.path: readers.file_format(f.path, f.format) for f in files}
    looks = shapes(lake.spark, formats.items())
    targets: dict[tuple[str, str], dict[tuple[str, str], list[str]]] = {}
    for f in sorted(files, key=lambda f: f.path):  # dicts keep this order
        targets.setdefault((f.tenant_id, f.table_name), {}).setdefault(looks[f.path], []).append(f.path)
    work = [(*target, [(*look, paths) for look, paths in groups.items()]) for target, groups in sorted(targets.items())]
    with ThreadPoolExecutor(PARALLEL_TARGETS) as pool:
        return [row for part in pool.map(lambda w: _ingest_target(lake, *w, tag, mode), work) for row in part]


def ingest_batch(lake: Lake, uploads: DataFrame, files: DataFrame, batch_id: int, mode: str = "by_name",
                 max_files: int = 1000) -> None:
    """Ingest the files of one micro-batch and some of those that were waiting for their registry row.

    The driver handles the names of registered files only, at most ``max_files`` of each kind: they are
    grouped by target table and shape, and the groups are read and written as distributed jobs.
    """
    retry_pending(lake, uploads, mode, max_files)
    tag = f"{batch_id:012d}"
    resolved = f"{lake.root}/registry/resolved/{tag}"
    _resolve(files, uploads).write.mode("overwrite").parquet(resolved)
    resolved = lake.spark.read.schema(RESOLVED).parquet(resolved)
    waiting = resolved.filter(F.col("tenant_id").isNull()).select("path")
    held, told = f"{lake.root}/registry/pending/{tag}", f"{lake.root}/registry/job_events/{tag}-pending"
    some = not waiting.isEmpty()
    if some:
        waiting.write.mode("overwrite").json(held)
    else:  # nor from an earlier attempt at this batch
        delete_folder(lake.spark, held)
    outcome = _ingest_files(lake, resolved.filter(F.col("tenant_id").isNotNull()).collect(), tag, mode)
    _events(lake, outcome, tag)
    if some:
        waiting.select("path", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("row_count"), F.lit(tag).alias(
            "batch_id"), F.current_timestamp().alias("at")).write.mode("overwrite").json(told)
    else:
        delete_folder(lake.spark, told)


RESOLVED = "path string, tenant_id string, table_name string, format string"
_LATE = f"n long, {RESOLVED}"


def _registry(lake: Lake, name: str, schema: str) -> DataFrame:
    """One table of the ingestion's own books; without a file it is empty."""
    folder = f"{lake.root}/registry/{name}"
    if not path_exists(lake.spark, folder):
        return lake.spark.createDataFrame([], schema)
    return lake.spark.read.schema(schema).option("recursiveFileLookup", True).json(folder)


def pending_files(lake: Lake) -> DataFrame:
    """Paths of files seen but not ingested for want of a registry row."""
    arrived = _registry(lake, "arrived", "n long, path string").select("path")
    return _registry(lake, "pending", "path string").distinct().join(arrived, "path", "left_anti")


def retry_pending(lake: Lake, uploads: DataFrame, mode: str = "by_name", max_files: int = 1000) -> int:
    """Ingest at most ``max_files`` waiting files whose registry row has come; returns how many.

    The choice is written down first, and struck off last: a call that was cut short is finished by the
    next one under the same batch ids, so nothing arrives twice and nothing is left out.
    """
    folder, plans = f"{lake.root}/registry", _registry(lake, "late", _LATE)
    if not path_exists(lake.spark, f"{folder}/pending"):
        return 0
    struck = _registry(lake, "arrived", "n long, path string").select("n").distinct()
    number = plans.join(struck, "n", "left_anti").agg(F.min("n")).first()[0]
    if number is None:
        number = (plans.agg(F.max("n")).first()[0] or 0) + 1
        chosen = _resolve(pending_files(lake), uploads).filter(F.col("tenant_id").isNotNull())
        chosen = chosen.orderBy("path").limit(max_files).withColumn("n", F.lit(number).cast("long"))
        chosen.write.mode("overwrite").json(f"{folder}/late/{number:08d}")
    files = lake.spark.read.schema(_LATE).json(f"{folder}/late/{number:08d}").collect()
    if files:
        tag = f"late{number:08d}"
        _events(lake, _ingest_files(lake, files, tag, mode), tag)
        lake.spark.createDataFrame([(number, f.path) for f in files], "n long, path string").coalesce(1).write.mode(
            "overwrite").json(f"{folder}/arrived/{number:08d}")
    return len(files)


def _resolve(files: DataFrame, uploads: DataFrame) -> DataFrame:
    """Attach tenant, table and format: equality on the key below the tenant folder; nulls where none is known."""
    key = F.regexp_extract("path", r"(tenants/[^/]+/raw/.*)$", 1)
    keyed = files.select("path", key.alias("file_key"))
    # An upload may be a single file or a folder of part files.
    keyed = keyed.withColumn("raw_file_path", F.explode(F.array(
        F.col("file_key"), F.regexp_replace("file_key", r"/[^/]+$", ""))))
    known = keyed.join(uploads, "raw_file_path").select("path", "tenant_id", "table_name", "format")
    return files.select("path").join(known, "path", "left").dropDuplicates(["path", "tenant_id", "table_name"])


def start_ingest(lake: Lake, uploads: Callable[[], DataFrame], checkpoint: str, mode: str = "by_name",
                 max_files: int = 1000, continuous: str | None = None) -> StreamingQuery:
    """Start the ingestion stream.

    ``uploads`` returns the current upload registry (``raw_file_path, tenant_id,
    table_name, format``) and is asked once per micro-batch. By default everything
    waiting is ingested and the query ends; ``continuous`` keeps it running at an interval.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(lake, uploads(), batch, batch_id, mode, max_files)

    # Without new files there may be no micro-batch, so waiting files are tried first.
    while retry_pending(lake, uploads(), mode, max_files):
        pass
    writer = raw_files(lake.spark, lake, max_files).writeStream.foreachBatch(handle).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()


def uploads_from(datasets: DataFrame) -> DataFrame:
    """Upload registry rows from the dataset registry (``table_fqn`` names the target)."""
    return datasets.filter(F.col("layer") != "gold").select(
        "raw_file_path", "tenant_id", F.substring_index("table_fqn", ".", -1).alias("table_name"), "format")
