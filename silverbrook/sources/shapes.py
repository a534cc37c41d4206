"""What many raw files look like, found in a fixed number of jobs: header, array or lines, column names and types.

Files are opened by the tasks, a few bytes each: the first record of a CSV file, the first character of a JSON
file, the footer of a Parquet file. Keys of JSON objects need a pass over the text, which is one job for all files.
Stores that the tasks cannot open by themselves are read through Spark instead, a few bytes per file as well.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_BYTES = 1 << 20
FILES_PER_TASK = 32


def plain_path(path: str) -> str:
    """One spelling per file: no escapes beyond the name's own, one slash after the scheme."""
    return re.sub(r"^([a-z][a-z0-9+.-]*):/+", r"\1:/", path)


def _first_record(head: str, sep: str = ",") -> list[str]:
    return next(csv.reader(io.StringIO(head.removeprefix("\ufeff"), newline=""), delimiter=sep), [])


def _is_array(head: str) -> bool:
    return head.lstrip("\ufeff \t\r\n").startswith("[")


def open_stored(path: str):
    """A stored file, or the first file with content of a folder, through the store that its path names."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    store, name = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.Directory:
        inside = sorted(f.path for f in store.get_file_info(fs.FileSelector(name, recursive=True))
                        if f.is_file and f.size and not re.search(r"/[._][^/]*$", f.path))
        if not inside:
            return io.BytesIO()
        name = inside[0]
    elif info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return store.open_input_file(name)


def _look(path: str, fmt: str) -> tuple[str, str | None, str | None]:
    """(kind, shape, error); a shape of null means that the file could not be looked at here."""
    try:
        with open_stored(path) as file:
            if fmt == "parquet":
                import pyarrow.parquet as pq

                try:
                    schema = pq.read_schema(file)
                except Exception as error:  # noqa: BLE001  no Parquet file: reported when it is read
                    return fmt, f"unreadable {plain_path(path)}", str(error)
                return fmt, json.dumps([[f.name, str(f.type)] for f in schema]), None
            head = file.read(HEAD_BYTES).decode("utf-8", "replace")
    except Exception as error:  # noqa: BLE001  another store, or gone: Spark reads it instead
        return fmt, None, str(error)
    if fmt == "csv":
        return fmt, json.dumps(_first_record(head)), None
    return ("array" if _is_array(head) else "lines"), "", None


def _by_spark(spark: SparkSession, path: str, fmt: str) -> tuple[str, str]:
    """The same through Spark's own readers, for stores that only they reach."""
    try:
        if fmt == "parquet":
            fields = spark.read.parquet(path).schema.fields
            return fmt, json.dumps([[f.name, f.dataType.simpleString()] for f in fields])
        if fmt == "csv":
            first = spark.read.options(header=False, multiLine=True, quote='"', escape='"').csv(path).limit(1).collect()
            return fmt, json.dumps([c or "" for c in first[0]] if first else [])
        first = spark.read.text(path).filter(F.col("value").rlike(r"\S")).take(1)
        return ("array" if first and _is_array(first[0]["value"]) else "lines"), ""
    except Exception:  # noqa: BLE001  unreadable: reported when it is read
        return fmt, f"unreadable {plain_path(path)}"


def heads(spark: SparkSession, files: Iterable[tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """path -> (kind, shape) for (path, format) pairs; kind is csv, parquet, array or lines. One job for all."""
    files = sorted(set(files))
    if not files:
        return {}

    def look(batches):
        for batch in batches:
            paths, formats = (batch.column(i).to_pylist() for i in range(2))
            found = [_look(p, f) for p, f in zip(paths, formats, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths), *(pa.array([x[i] for x in found], pa.string()) for i in range(2))],
                ["path", "kind", "shape"])

    frame = spark.createDataFrame(files, "path string, format string").repartition(-(-len(files) // FILES_PER_TASK))
    out = {r.path: (r.kind, r.shape) for r in frame.mapInArrow(look, "path string, kind string, shape string").collect()}
    other = [(p, f) for p, f in files if out[p][1] is None]
    if other:
        with ThreadPoolExecutor(16) as pool:
            out.update(zip([p for p, _ in other], pool.map(lambda x: _by_spark(spark, *x), other), strict=True))
    return out


def json_keys(spark: SparkSession, lines: Sequence[str], arrays: Sequence[str]) -> dict[str, str]:
    """path -> its sorted top-level keys, from one pass over all files of each kind."""
    parts = []
    if lines:
        rows = spark.read.text(list(lines)).select(
            F.input_file_name().alias("file"), F.explode(F.json_object_keys("value")).alias("key"))
        parts.append(rows)
    if arrays:
        whole = spark.read.text(list(arrays), wholetext=True)
        items = F.explode(F.from_json(F.ltrim("value", F.lit("\ufeff")), "array<map<string,string>>"))
        rows = whole.select(F.input_file_name().alias("file"), items.alias("item"))
        parts.append(rows.select("file", F.explode(F.map_keys("item")).alias("key")))
    if not parts:
        return {}
    keys = reduce(DataFrame.unionByName, parts).distinct().groupBy("file").agg(
        F.to_json(F.sort_array(F.collect_list("key"))).alias("keys"))
    return {plain_path(unquote(r.file)): r["keys"] for r in keys.collect()}


def shapes(spark: SparkSession, files: Iterable[tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """path -> (kind, shape): files of one kind and shape have the same columns and can be read together."""
    found = heads(spark, files)
    by_kind = {k: [p for p, (kind, shape) in found.items() if kind == k and not shape] for k in ("lines", "array")}
    keys = {}
    try:
        keys = json_keys(spark, by_kind["lines"], by_kind["array"])
    except Exception:  # noqa: BLE001  a file among them cannot be read: find out which, file by file
        for kind, paths in by_kind.items():
            for path in paths:
                try:
                    keys.update(json_keys(spark, *(([path], []) if kind == "lines" else ([], [path]))))
                except Exception:  # noqa: BLE001
                    keys[plain_path(path)] = f"unreadable {plain_path(path)}"
    for paths in by_kind.values():
        for path in paths:
            found[path] = (found[path][0], keys.get(plain_path(path), "[]"))
    return found
