"""Silver and Gold tables: batch-tagged appends that become visible by a commit row.

A batch is written to its own ``batch_id=…`` folder, so a retry overwrites its own files
and nothing else. It shows up for readers once a row in the commit log names it. Reading
an older version selects on that log. Snapshot numbers are claimed by creating a file that
must not exist, so two writers never share one; totals are added up from the log.

The log is cut into segments of ``CHECKPOINT_EVERY`` snapshot numbers, and the whole log is written
as one checkpoint whenever a segment is full. Readers take the newest checkpoint and the segments
after it, so what a commit reads does not grow with the number of files before it. A checkpoint is
announced by a fence before it reads the log. A writer that finds a fence above its own number after
writing its row cannot know whether the checkpoint has it, and writes it again above the fence; of
two rows of one batch the first counts. ``vacuum`` removes what no retained snapshot shows.
"""

from __future__ import annotations

import json
import time
import uuid
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from dataclasses import replace as replace_field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverbrook.sources.storage import create_new, delete_folder, list_files, names_in, path_exists, safe_name

FOLDERS = {"silver": "tables", "gold": "gold"}

CHECKPOINT_EVERY = 50

COMMIT_SCHEMA = (
    T.StructType().add("tenant_id", "string").add("layer", "string").add("table_name", "string")
    .add("batch_id", "string").add("snapshot_id", "long").add("replaces", "boolean").add("row_count", "long")
    .add("total_rows", "long").add("duration_ms", "long").add("table_schema", "string").add("committed_at", "timestamp")
)


@dataclass(frozen=True)
class CommitResult:
    table: str
    batch_id: str
    snapshot_id: int
    batch_rows: int
    total_rows: int
    columns: list[str]
    duration_ms: int


class BatchRejected(Exception):
    """The audit of a written batch turned it down; it stays invisible."""


class Lake:
    """Tables of all tenants below one storage root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # locations ---------------------------------------------------------------------
    def table_folder(self, tenant: str, table: str, layer: str = "silver") -> str:
        return f"{self.root}/tenants/{safe_name(tenant)}/{FOLDERS[layer]}/{safe_name(table)}"

    def raw_folder(self, tenant: str) -> str:
        return f"{self.root}/tenants/{safe_name(tenant)}/raw"

    def _log_folder(self, tenant: str, table: str, layer: str) -> str:
        return f"{self.root}/registry/commits/{safe_name(tenant)}/{layer}/{safe_name(table)}"

    def _checkpoints(self, tenant: str, table: str, layer: str) -> str:
        return f"{self.root}/registry/checkpoints/{safe_name(tenant)}/{layer}/{safe_name(table)}"

    # commit log --------------------------------------------------------------------
    def commits(self) -> DataFrame:
        """Every commit of every table."""
        logs, points = f"{self.root}/registry/commits", f"{self.root}/registry/checkpoints"
        parts = [self._rows("json", logs)] if path_exists(self.spark, logs) else []
        if path_exists(self.spark, points):
            parts.append(self._rows("parquet", points))
        return self._totals(parts)

    def _rows(self, fmt: str, *folders: str) -> DataFrame:
        return self.spark.read.format(fmt).schema(COMMIT_SCHEMA).option("recursiveFileLookup", True).load(list(folders))

    def _totals(self, parts: list[DataFrame]) -> DataFrame:
        """Each commit once; ``total_rows`` is added up since the last overwrite."""
        if not parts:
            return self.spark.createDataFrame([], COMMIT_SCHEMA)
        key = ["tenant_id", "layer", "table_name"]
        log = reduce(DataFrame.unionByName, parts)
        again = Window.partitionBy(*key, "batch_id").orderBy("snapshot_id")
        log = log.withColumn("_copy", F.row_number().over(again)).where("_copy = 1")
        since = log.withColumn("_since", F.sum(F.col("replaces").cast("int")).over(
            Window.partitionBy(*key).orderBy("snapshot_id")))
        total = F.sum("row_count").over(Window.partitionBy(*key, "_since").orderBy("snapshot_id"))
        return since.withColumn("total_rows", total).select(*COMMIT_SCHEMA.names)

    def _last_checkpoint(self, tenant: str, table: str, layer: str) -> int:
        """Number of the newest complete checkpoint, or 0."""
        folder = self._checkpoints(tenant, table, layer)
        numbers = sorted((int(n) for n in names_in(self.spark, folder) if n.isdigit()), reverse=True)
        return next((n for n in numbers if path_exists(self.spark, f"{folder}/{n:012d}/_SUCCESS")), 0)

    def _segment(self, tenant: str, table: str, layer: str, number: int) -> str:
        return f"{self._log_folder(tenant, table, layer)}/{number // CHECKPOINT_EVERY:010d}"

    def _tail(self, tenant: str, table: str, layer: str, after: int) -> list[str]:
        """Folders of the segments that may hold commits after a checkpoint."""
        folder = self._log_folder(tenant, table, layer)
        numbers = sorted(n for n in names_in(self.spark, folder) if n.isdigit())
        return [f"{folder}/{n}" for n in numbers if int(n) >= after // CHECKPOINT_EVERY]

    def _checkpoint(self, tenant: str, table: str, layer: str, number: int) -> None:
        """Write the log up to ``number`` as one file; whoever announces it first does it."""
        folder = self._checkpoints(tenant, table, layer)
        if create_new(self.spark, f"{folder}/_fences/{number:012d}"):
            log = self.history(tenant, table, layer).filter(F.col("snapshot_id") <= number)
            log.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{number:012d}")

    def _fenced(self, tenant: str, table: str, layer: str, number: int) -> bool:
        fences = names_in(self.spark, f"{self._checkpoints(tenant, table, layer)}/_fences")
        return any(int(n) >= number for n in fences if n.isdigit())

    def history(self, tenant: str, table: str, layer: str = "silver") -> DataFrame:
        """Commits of one table."""
        last = self._last_checkpoint(tenant, table, layer)
        parts = [self._rows("parquet", f"{self._checkpoints(tenant, table, layer)}/{last:012d}")] if last else []
        tail = self._tail(tenant, table, layer, last)
        return self._totals(parts + ([self._rows("json", *tail)] if tail else []))

    def batch_ids(self, tenant: str, table: str, prefix: str, layer: str = "silver") -> set[str]:
        """Committed batches of one table whose id starts with ``prefix``."""
        log = self.history(tenant, table, layer).filter(F.startswith("batch_id", F.lit(prefix)))
        return {r.batch_id for r in log.select("batch_id").collect()}

    def _claim_snapshot(self, tenant: str, table: str, layer: str, last: int) -> int:
        """The next free snapshot number; the file that claims it is nobody else's."""
        number = last + 1
        while not create_new(self.spark, f"{self._log_folder(tenant, table, layer)}/_claims/{number:012d}"):
            number += 1
        return number

    def _state(self, tenant: str, table: str, layer: str, batch_id: str | None = None):
        """Head of the log in one small aggregate: last snapshot, schema, total, given batch."""
        log = self.history(tenant, table, layer)
        head = F.max_by(F.struct("table_schema", "total_rows"), "snapshot_id")
        mine = F.max(F.when(F.col("batch_id") == batch_id, F.struct("snapshot_id", "row_count", "duration_ms")))
        return log.agg(F.max("snapshot_id").alias("snapshot"), head.alias("head"), mine.alias("done")).first()

    @staticmethod
    def _schema(state) -> T.StructType | None:
        return T.StructType.fromJson(json.loads(state.head.table_schema)) if state.head else None

    def schema_of(self, tenant: str, table: str, layer: str = "silver") -> T.StructType | None:
        """Schema fixed by the first commit, plus columns later batches were allowed to add."""
        return self._schema(self._state(tenant, table, layer))

    def _visible(self, tenant: str, table: str, layer: str, as_of: int | None) -> DataFrame:
        log = self.history(tenant, table, layer)
        if as_of is not None:
            log = log.filter(F.col("snapshot_id") <= as_of)
        # An overwrite hides everything before it.
        floor = log.filter("replaces").agg(F.max("snapshot_id")).first()[0] or 0
        return log.filter(F.col("snapshot_id") >= floor)

    # writes ------------------------------------------------------------------------
    @staticmethod
    def _fit(df: DataFrame, target: T.StructType, mode: str) -> tuple[list[Column], T.StructType]:
        """Columns that shape a batch like its table, and the table schema after the batch."""
        if mode == "by_position":
            if len(df.columns) != len(target.fields):
                raise ValueError(f"batch has {len(df.columns)} columns, table has {len(target.fields)}")
            pairs = zip(df.columns, target.fields)
            return [F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in pairs], target
        extra = [f for f in df.schema.fields if f.name not in target.names]
        missing = [n for n in target.names if n not in df.columns]
        if mode != "evolve" and (extra or missing):
            raise ValueError(f"columns do not match: unexpected {[f.name for f in extra]}, missing {missing}")
        kept = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in target.fields if f.name not in missing]
        added = [F.col(f"`{f.name}`") for f in extra]
        return kept + added, T.StructType(target.fields + extra)

    def commit(self, tenant: str, table: str, df: DataFrame, layer: str = "silver",
               batch_id: str | None = None, mode: str = "by_name", replace: bool = False,
               publish: bool = True, hidden: Sequence[str] = (),
               audit: Callable[[DataFrame], bool] | None = None) -> CommitResult:
        """Create the table or append a batch to it.

        ``mode`` is ``by_name``, ``by_position`` or ``evolve`` (columns may come and go).
        ``batch_id`` makes the call repeatable: a committed batch is left alone, a half
        written one is written again. Without ``publish`` the batch stays invisible.
        ``hidden`` columns are stored in the files but are not part of the table.
        ``audit`` sees the written batch and may refuse it before it becomes visible.
        """
        batch_id, started = safe_name(batch_id or uuid.uuid4().hex), time.monotonic()
        state = self._state(tenant, table, layer, batch_id)
        current, name = self._schema(state), f"{tenant}_{layer}.{table}"
        if state.done:
            return CommitResult(name, batch_id, state.done.snapshot_id, state.done.row_count,
                                state.head.total_rows, current.names, state.done.duration_ms)
        kept = [F.col(f"`{c}`") for c in hidden]
        plain = df.drop(*hidden)
        if current is None or replace:
            table_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in plain.schema.fields])
        else:
            shaped, table_schema = self._fit(plain, current, mode)
            df = df.select(*shaped, *kept)
        counted = Observation()
        folder = f"{self.table_folder(tenant, table, layer)}/batch_id={batch_id}"
        df.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(folder)
        rows = counted.get["n"]
        if audit is not None and not audit(self.spark.read.parquet(folder)):
            raise BatchRejected(folder)
        last, before = state.snapshot or 0, 0 if replace or not state.head else state.head.total_rows
        number = last + 1
        done = CommitResult(name, batch_id, number, rows, before + rows, table_schema.names,
                            int((time.monotonic() - started) * 1000))
        if publish:
            number = self._log_commit(tenant, table, layer, last, (
                tenant, layer, table, batch_id, number, replace, rows, done.total_rows, done.duration_ms,
                table_schema.json()))
            done = replace_field(done, snapshot_id=number)
            if number != last + 1:  # somebody else committed meanwhile
                row = self.history(tenant, table, layer).filter(F.col("batch_id") == batch_id).first()
                done = replace_field(done, snapshot_id=row.snapshot_id, total_rows=row.total_rows)
            try:
                self.publish(tenant, table, layer, schema=table_schema, added=None if replace else batch_id)
            except Exception as error:  # noqa: BLE001  the rows are committed; publish_all can repeat this
                warnings.warn(f"{name} is committed but not in the catalog: {str(error).splitlines()[0]}", stacklevel=2)
        return done

    def _log_commit(self, tenant: str, table: str, layer: str, last: int, entry: tuple) -> int:
        """Make a batch visible by its log row, under a number of its own; returns the number."""
        while True:
            number = self._claim_snapshot(tenant, table, layer, last)
            row = entry[:4] + (number,) + entry[5:]
            (
                self.spark.createDataFrame([row], T.StructType(COMMIT_SCHEMA.fields[:-1]))
                .withColumn("committed_at", F.current_timestamp())
                .coalesce(1).write.mode("overwrite")
                .json(f"{self._segment(tenant, table, layer, number)}/{entry[3]}")
            )
            if not self._fenced(tenant, table, layer, number):
                break
            last = number  # a checkpoint may have been written without the row
        if number % CHECKPOINT_EVERY == 0:
            self._checkpoint(tenant, table, layer, number)
        return number

    # reads -------------------------------------------------------------------------
    def read(self, tenant: str, table: str, layer: str = "silver", as_of: int | None = None) -> DataFrame:
        """Committed rows, now or as of an earlier snapshot.

        The semi-join on the folder key lets Spark skip the folders of hidden batches.
        """
        schema = self.schema_of(tenant, table, layer)
        if schema is None:
            raise LookupError(f"no such table: {tenant}_{layer}.{table}")
        if as_of is not None and as_of < self._oldest(tenant, table, layer):
            raise LookupError(f"snapshot {as_of} of {tenant}_{layer}.{table} is past its retention")
        stored = T.StructType(schema.fields + [T.StructField("batch_id", T.StringType())])
        data = self.spark.read.schema(stored).parquet(self.table_folder(tenant, table, layer))
        visible = self._visible(tenant, table, layer, as_of).select("batch_id")
        return data.join(visible, "batch_id", "left_semi").select(*schema.names)

    # catalog -----------------------------------------------------------------------
    def publish(self, tenant: str, table: str, layer: str = "silver", schema: T.StructType | None = None,
                added: str | None = None) -> str:
        """Make the committed rows queryable as ``{tenant}_{layer}.{table}``.

        The catalog table lists committed folders only, so it never shows a half written
        batch; a view over it hides the folder key. Silver tables also get the flat
        alias ``{tenant}_{table}``. With ``added`` an up-to-date entry gains that one
        batch; otherwise the entry is rebuilt from the log.
        """
        spark, schema_name = self.spark, f"{tenant}_{layer}"
        base, name = f"`{schema_name}`.`{table}__batches`", f"`{schema_name}`.`{table}`"
        folder = self.table_folder(tenant, table, layer)
        schema = schema or self.schema_of(tenant, table, layer)
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema_name}`")
        fresh = added is not None and spark.catalog.tableExists(base) and (
            spark.table(base).drop("batch_id").columns == schema.names)
        if fresh:
            batches = [added]
        else:
            spark.sql(f"DROP TABLE IF EXISTS {base}")
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            spark.sql(f"CREATE TABLE {base} ({fields}, batch_id STRING) USING parquet "
                      f"PARTITIONED BY (batch_id) LOCATION '{folder}'")
            visible = self._visible(tenant, table, layer, None).select("batch_id")
            batches = [r.batch_id for r in visible.toLocalIterator()]
        if batches:  # one statement, however many batches
            parts = " ".join(f"PARTITION (batch_id='{b}') LOCATION '{folder}/batch_id={b}'" for b in batches)
            spark.sql(f"ALTER TABLE {base} ADD IF NOT EXISTS {parts}")
        spark.catalog.refreshTable(base)
        columns = ", ".join(f"`{n}`" for n in schema.names)
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM {base}")
        if layer == "silver":
            spark.sql(f"CREATE OR REPLACE VIEW `{tenant}_{table}` AS SELECT * FROM {name}")
        return f"{schema_name}.{table}"

    def publish_all(self, tenant: str | None = None) -> list[str]:
        """Rebuild the catalog from the commit log, as at the start of a session."""
        tables = self.commits().select("tenant_id", "table_name", "layer").distinct()
        if tenant is not None:
            tables = tables.filter(F.col("tenant_id") == tenant)
        return [self.publish(t.tenant_id, t.table_name, t.layer) for t in tables.toLocalIterator()]

    # removal -----------------------------------------------------------------------
    def drop(self, tenant: str, name: str, layer: str = "silver", object_type: str = "table") -> bool:
        """Drop one object and, unless it is a view, its folder. Returns whether files went."""
        schema_name = f"{safe_name(tenant)}_{layer}"
        if self.spark.catalog.databaseExists(schema_name):
            self.spark.sql(f"DROP VIEW IF EXISTS `{schema_name}`.`{safe_name(name)}`")
            self.spark.sql(f"DROP TABLE IF EXISTS `{schema_name}`.`{name}__batches`")
        if layer == "silver":
            self.spark.sql(f"DROP VIEW IF EXISTS `{tenant}_{name}`")
        if object_type == "view":
            return False
        # Data goes first: a call that was cut short leaves the log, and can be repeated.
        went = delete_folder(self.spark, self.table_folder(tenant, name, layer))
        delete_folder(self.spark, self._checkpoints(tenant, name, layer))
        delete_folder(self.spark, self._log_folder(tenant, name, layer))
        return went

    def _oldest(self, tenant: str, table: str, layer: str) -> int:
        """The oldest snapshot that a vacuum left readable."""
        kept = names_in(self.spark, f"{self._log_folder(tenant, table, layer)}/_oldest")
        return max((int(n) for n in kept if n.isdigit()), default=0)

    def vacuum(self, tenant: str, table: str, layer: str = "silver", oldest: int | None = None,
               hidden_hours: float = 24.0) -> DataFrame:
        """Remove batch folders that no snapshot from ``oldest`` on (by default the newest) shows; returns them.

        Replaced batches go by the log. Folders without a commit row go when nothing in them is younger than
        ``hidden_hours``, the longest a writer may take. Log segments that the checkpoint holds go too.
        Older snapshots are refused by ``read`` from then on. A call that was cut short can be repeated.
        """
        log = self.history(tenant, table, layer)
        newest = log.agg(F.max("snapshot_id")).first()[0] or 0
        oldest = min(newest, newest if oldest is None else oldest)
        floor = log.filter((F.col("snapshot_id") <= oldest) & F.col("replaces")).agg(F.max("snapshot_id")).first()[0] or 0
        create_new(self.spark, f"{self._log_folder(tenant, table, layer)}/_oldest/{oldest:012d}")
        folder = self.table_folder(tenant, table, layer)
        batch = F.regexp_extract("path", r"batch_id=([^/]+)/", 1)
        stored = list_files(self.spark, folder).groupBy(batch.alias("batch_id")).agg(
            F.max("modified_at").alias("written"), F.sum("length").alias("n_bytes")).where("batch_id <> ''")
        live = log.filter(F.col("snapshot_id") >= floor).select("batch_id")
        known = log.select("batch_id", F.col("snapshot_id").alias("last_snapshot"))
        settled = F.current_timestamp() - F.make_dt_interval(hours=F.lit(int(hidden_hours)),
                                                             mins=F.lit(int(hidden_hours * 60) % 60))
        gone = stored.join(live, "batch_id", "left_anti").join(known, "batch_id", "left").where(
            F.col("last_snapshot").isNotNull() | (F.col("written") < settled))
        path = f"{self.root}/registry/vacuumed/{uuid.uuid4().hex}"
        gone.select("batch_id", "n_bytes", F.when(F.col("last_snapshot").isNull(), "hidden").otherwise("replaced").alias(
            "reason")).write.parquet(path)
        gone = self.spark.read.parquet(path)
        for row in gone.select("batch_id").toLocalIterator():
            delete_folder(self.spark, f"{folder}/batch_id={safe_name(row.batch_id)}")
        last = self._last_checkpoint(tenant, table, layer)
        for segment in names_in(self.spark, self._log_folder(tenant, table, layer)):
            if segment.isdigit() and int(segment) < last // CHECKPOINT_EVERY:
                delete_folder(self.spark, f"{self._log_folder(tenant, table, layer)}/{segment}")
        for point in names_in(self.spark, self._checkpoints(tenant, table, layer)):
            if point.isdigit() and int(point) < last:
                delete_folder(self.spark, f"{self._checkpoints(tenant, table, layer)}/{point}")
        return gone

    def purge_tenant(self, tenant: str) -> dict[str, int]:
        """Remove every object of one tenant and say how many of each kind went.

        Names come from the commit log, never a pattern. The log goes last, so a call that
        was cut short can be repeated and finds what is left.
        """
        owned = self.commits().filter(F.col("tenant_id") == safe_name(tenant))
        names = [r.table_name for r in owned.filter("layer = 'silver'").select("table_name").distinct().toLocalIterator()]
        for name in names:
            self.spark.sql(f"DROP VIEW IF EXISTS `{tenant}_{name}`")
        schemas = [f"{tenant}_{layer}" for layer in FOLDERS if self.spark.catalog.databaseExists(f"{tenant}_{layer}")]
        for schema in schemas:
            self.spark.sql(f"DROP SCHEMA IF EXISTS `{schema}` CASCADE")
        gone = {"aliases": len(names), "schemas": len(schemas), "folders": 0}
        for folder in (f"tenants/{tenant}", f"registry/gold/{tenant}", f"registry/checkpoints/{tenant}", f"registry/commits/{tenant}"):
            gone["folders"] += delete_folder(self.spark, f"{self.root}/{folder}")
        return gone


def without_tenants(registry: DataFrame, purged: DataFrame) -> DataFrame:
    """Registry rows that survive a purge of the given tenants (exact key match)."""
    return registry.join(purged.select("tenant_id").distinct(), "tenant_id", "left_anti")


def visible_rows(data: DataFrame, commits: DataFrame, as_of: int | None = None,
                 keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Rows whose batch is committed, optionally as of a snapshot."""
    if as_of is not None:
        commits = commits.filter(F.col("snapshot_id") <= as_of)
    return data.join(commits.select(*keys).distinct(), list(keys), "left_semi")
