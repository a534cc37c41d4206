"""Result exports and file manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverbrook.sources.shapes import open_stored

PIECE = 64 << 20  # bytes of a file that are one leaf of its hash tree
FAN = 1024  # digests below a node, at most
READ = 1 << 20  # bytes in memory at a time
PIECES_PER_TASK = 64


def _as_text(df: DataFrame, name: str) -> Column:
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as CSV text: quoted only where a comma, quote or line break demands it."""
    cells = []
    for name in df.columns:
        text = F.coalesce(_as_text(df, name), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        cells.append(F.when(text.rlike('[,"\n]'), quoted).otherwise(text))
    return df.select(F.array_join(F.array(*cells), ",").alias("line"))


def tsv_header(df: DataFrame) -> str:
    """The line with the column names."""
    return "\t".join(df.columns)


def tsv_lines(df: DataFrame) -> DataFrame:
    """Rows as tab-separated text: tabs inside values become blanks, nulls empty."""
    cells = [
        F.coalesce(F.replace(_as_text(df, n), F.lit("\t"), F.lit(" ")), F.lit("")) for n in df.columns
    ]
    return df.select(F.array_join(F.array(*cells), "\t").alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON objects keyed by column; nulls are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def export_csv(df: DataFrame, path: str) -> str:
    """CSV files with a header line, written in parallel."""
    df.select(*[_as_text(df, n).alias(n) for n in df.columns]).write.csv(
        path, header=True, quote='"', escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False)
    return path


def export_json(df: DataFrame, path: str) -> str:
    """One JSON object per line, written in parallel."""
    df.write.option("ignoreNullFields", False).json(path)
    return path


def export_json_array(df: DataFrame, path: str) -> str:
    """JSON documents, each one array of row objects: one document per write task."""
    def documents(batches):
        opened = False
        for batch in batches:
            if len(batch):
                lines = "," + batch["line"]
                if not opened:
                    lines.iloc[0] = "[" + lines.iloc[0][1:]
                    opened = True
                yield batch.assign(line=lines)
        yield pd.DataFrame({"line": ["]" if opened else "[]"]})

    json_lines(df).mapInPandas(documents, "line string").write.text(path)
    return path


def export_tsv(df: DataFrame, path: str) -> str:
    """Tab-separated text without quoting, written in parallel; every file starts with the column names."""
    header = tsv_header(df)

    def files(batches):
        started = False
        for batch in batches:
            if len(batch):
                yield batch if started else pd.concat([pd.DataFrame({"line": [header]}), batch])
                started = True

    tsv_lines(df).mapInPandas(files, "line string").write.text(path)
    return path


def _ranges(large: DataFrame, n_pieces: int, piece: int) -> DataFrame:
    """(path, n_bytes, width, i, digest): SHA-256 of every piece; a file has ``width`` of them, read by different tasks."""
    spark = large.sparkSession
    tasks = max(min(n_pieces, 4 * spark.sparkContext.defaultParallelism), n_pieces // PIECES_PER_TASK)
    pieces = large.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, i in zip(batch.column("path").to_pylist(), batch.column("i").to_pylist(), strict=True):
                sha, left = hashlib.sha256(), piece
                with open_stored(path) as file:
                    file.seek(i * piece)
                    while left and (data := file.read(min(left, READ))):
                        sha.update(data)
                        left -= len(data)
                out.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "digest"])

    # The number is given, or adaptive execution would put these few bytes of work orders into one task.
    return pieces.repartition(tasks, "path", "i").mapInArrow(
        digests, "path string, n_bytes long, width long, i long, digest string")


def _roots(tree: DataFrame, width: int, fan: int) -> DataFrame:
    """(path, n_bytes, sha256): level by level, up to ``fan`` digests of a file are put together."""
    while width > 1:
        below = F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"])
        tree = tree.groupBy("path", "n_bytes", "width", F.floor(F.col("i") / fan).alias("up")).agg(below.alias("below")).select(
            "path", "n_bytes", F.ceil(F.col("width") / fan).alias("width"), F.col("up").alias("i"),
            F.when(F.col("width") > 1, F.sha2(F.array_join("below", ""), 256)).otherwise(F.get("below", F.lit(0))).alias("digest"))
        width = -(-width // fan)
    return tree.select("path", "n_bytes", F.col("digest").alias("sha256"))


def manifest(spark: SparkSession, root: str, pattern: str = "*", piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """(path, n_bytes, sha256) of every stored file, computed where the files are read.

    Files up to ``piece`` bytes have their SHA-256. Larger ones are read in ranges of so many bytes by many tasks, and
    have the root of a tree: a leaf is the SHA-256 of one range, a node that of up to ``fan`` hex digests below it in
    order. A root depends on the file, ``piece`` and ``fan`` only, so manifests are compared under equal parameters.
    No file is ever one value, and no node gathers more than ``fan`` digests. Large files need a store that
    ``pyarrow.fs`` can open; small ones are read by Spark, which lists no empty files.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base)
    found = files.where(F.col("length") <= piece).select(
        "path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > piece).select(
        "path", F.col("length").alias("n_bytes"), F.ceil(F.col("length") / piece).alias("width"))
    total, widest = large.agg(F.sum("width"), F.max("width")).first()
    if total:
        found = found.unionByName(_roots(_ranges(large, total, piece), widest, fan))
    at = F.instr(F.col("path"), base) + len(base) + 1
    return found.withColumn("path", F.substr("path", at))


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added, removed or changed between two manifests."""
    b = before.select("path", F.col("sha256").alias("before_sha256"))
    a = after.select("path", F.col("sha256").alias("after_sha256"))
    state = (
        F.when(F.col("before_sha256").isNull(), "added").when(F.col("after_sha256").isNull(), "removed")
        .when(F.col("before_sha256") != F.col("after_sha256"), "changed"))
    return b.join(a, "path", "full").withColumn("change", state).filter(F.col("change").isNotNull())


def manifest_totals(files: DataFrame) -> DataFrame:
    """File count and bytes, the numbers a restore is checked against."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))
