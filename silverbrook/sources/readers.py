"""Raw file readers: CSV, Parquet and JSON with cleaned column names.

A reader returns a lazy DataFrame. Inference needs a pass over the raw text, so once a
table exists its schema should be passed in: the scan then happens once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverbrook.functions.naming import clean_columns, unique_names
from silverbrook.sources import csv_split
from silverbrook.sources.shapes import heads
from silverbrook.sources.storage import files_below, stored_bytes

Paths = str | Sequence[str]

_WIDENED = {
    T.ByteType: T.LongType(),
    T.ShortType: T.LongType(),
    T.IntegerType: T.LongType(),
    T.TimestampType: T.TimestampNTZType(),
}

_ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
_ISO_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"


def _paths(path: Paths) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def locate(path: str, root: str | None = None) -> str:
    """Full location of a raw file: URLs and absolute paths stay, bare keys go below ``root``."""
    path = path.strip().replace("\\", "/")
    if re.match(r"^[a-z][a-z0-9+.-]*:/", path) or path.startswith("/") or root is None:
        return path
    return f"{root.rstrip('/')}/{path.lstrip('/')}"


def widen(schema: T.StructType) -> T.StructType:
    """Inferred integers become long, timestamps lose their session time zone."""
    return T.StructType([
        T.StructField(f.name, _WIDENED.get(type(f.dataType), f.dataType), True) for f in schema.fields
    ])


_CSV = {"quote": '"', "escape": '"'}


def csv_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Raw column names of one file; reads its first record only. A file without content has none."""
    first = spark.read.options(header=False, sep=sep, multiLine=True, **_CSV).csv(path).limit(1).collect()
    return [c or "" for c in first[0]] if first else []


def _large(spark: SparkSession, paths: list[str]) -> bool:
    """Whether any file or folder is larger than what one task reads."""
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return any(stored_bytes(spark, p) > most for p in paths)


def read_csv(spark: SparkSession, path: Paths, schema: T.StructType | None = None, sep: str = ",",
             corrupt_column: str | None = None, multi_line: bool | None = None, file_column: str | None = None) -> DataFrame:
    """Comma-separated text with a header line and inferred types; quoted cells may hold line breaks.

    With ``schema`` the columns it names get its types, whatever their order in the files; only
    other columns are inferred. Files of one call must share their header. ``corrupt_column``
    adds the raw text of lines that do not fit the types instead of failing, ``file_column`` the file.

    Files larger than a task's share are read by many tasks: as lines where no quoted cell of any file holds a
    line break, else as the records that ``csv_split`` finds. ``multi_line`` takes one of Spark's two ways instead.
    """
    paths = _paths(path)
    opened = None
    if multi_line is None:
        multi_line = True
        if _large(spark, paths):
            states = csv_split.block_states(spark, paths, sep).cache()
            if states.where("broken").isEmpty():
                multi_line = False
            else:
                opened = {(r.file, r.block) for r in states.where("inside").collect()}
                returns = {r.file for r in states.where("returns").select("file").distinct().collect()}
            states.unpersist()
    options = {"sep": sep, "multiLine": multi_line, **_CSV}
    reader = spark.read.options(header=True, **options)
    if opened is None:
        def infer():
            return reader.option("inferSchema", True).csv(paths).schema
    else:
        rows = csv_split.records(spark, paths, opened, returns, sep)

        def infer():
            return spark.read.options(inferSchema=True, **options).csv(rows.select("record").rdd.map(lambda r: r[0])).schema

    header = csv_header(spark, paths[0], sep) if schema is not None or opened is not None else None
    if schema is None:
        fields = widen(infer()).fields
        names = unique_names(header or [f.name for f in fields])
    else:
        names, types = unique_names(header), {f.name: f.dataType for f in schema.fields}
        fields = [T.StructField(n, types.get(n)) for n in names if n in types]
        if len(fields) < len(names):
            inferred = widen(infer()).fields
            fields = [T.StructField(n, types.get(n, f.dataType)) for n, f in zip(names, inferred, strict=True)]
    fields = [T.StructField(n, f.dataType, True) for n, f in zip(names, fields, strict=True)]
    options["mode"] = "FAILFAST"
    if corrupt_column:
        fields.append(T.StructField(corrupt_column, T.StringType()))
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt_column}
    shape = T.StructType(fields)
    if opened is None:
        df = spark.read.options(header=True, **options).schema(shape).csv(paths)
        return df.withColumn(file_column, F.input_file_name()) if file_column else df
    texts = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    df = rows.select("file", F.from_csv("record", ddl, texts).alias("row"))
    return df.select("row.*", *([F.col("file").alias(file_column)] if file_column else []))


def read_parquet(spark: SparkSession, path: Paths) -> DataFrame:
    return clean_columns(spark.read.parquet(*_paths(path)))


def _fits(value: Column, pattern: str, type_name: str) -> Column:
    """Whether a text reads as the type; null for null, which leaves the vote open."""
    return F.when(value.isNotNull(), value.rlike(pattern) & value.try_cast(type_name).isNotNull())


def _promote_dates(df: DataFrame, among: Sequence[str]) -> DataFrame:
    """Turn string columns whose every value is an ISO date or timestamp into that type."""
    strings = [f.name for f in df.schema.fields if f.name in among and isinstance(f.dataType, T.StringType)]
    if not strings:
        return df
    checks = []
    for i, name in enumerate(strings):
        value = F.col(f"`{name}`")
        checks += [
            F.bool_and(_fits(value, _ISO_DATE, "date")).alias(f"d{i}"),
            F.bool_and(_fits(value, _ISO_TIMESTAMP, "timestamp_ntz")).alias(f"t{i}"),
        ]
    verdict = df.agg(*checks).first()
    casts = {
        name: "date" if verdict[f"d{i}"] else "timestamp_ntz"
        for i, name in enumerate(strings) if verdict[f"d{i}"] or verdict[f"t{i}"]
    }
    return df.select(*[
        F.col(f"`{c}`").cast(casts[c]).alias(c) if c in casts else F.col(f"`{c}`") for c in df.columns
    ])


def _read_json(spark: SparkSession, paths: list[str], multi_line: bool, schema: T.StructType | None,
               corrupt_column: str | None) -> DataFrame:
    hidden = corrupt_column or "_corrupt_record"
    reader = spark.read.option("multiLine", multi_line).option("columnNameOfCorruptRecord", hidden)
    found = [f for f in reader.json(paths).schema.fields if f.name != hidden]
    names = unique_names([f.name for f in found])
    types = {f.name: f.dataType for f in schema.fields} if schema else {}
    # Raw keys with the table's types: a value that does not fit makes the line corrupt.
    read = [T.StructField(f.name, types.get(n, f.dataType)) for f, n in zip(found, names, strict=True)]
    mode = "PERMISSIVE" if corrupt_column else "FAILFAST"
    tail = [T.StructField(hidden, T.StringType())] if corrupt_column else []
    df = reader.option("mode", mode).schema(T.StructType(read + tail)).json(paths)
    df = df.toDF(*names, *[f.name for f in tail])
    if schema is None:
        # File order of the keys is not kept by inference, which sorts them by name.
        return _promote_dates(df, [n for n in df.columns if n != corrupt_column])
    absent = [f for f in schema.fields if f.name not in names]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}) if absent else df


def read_json(spark: SparkSession, path: Paths, schema: T.StructType | None = None,
              corrupt_column: str | None = None, array: bool | None = None) -> DataFrame:
    """One JSON array, or one object per line, decided file by file; nested values keep their structure.

    The first character of each file decides, found for all files in one job unless ``array`` says it.

    With ``schema`` keys are matched by their cleaned names and absent ones are null.
    ``corrupt_column`` adds the text of lines that are no JSON or do not fit. Line-delimited input
    splits across tasks. A single array document does not: that is the format's limit, so several
    arrays should arrive as several files.
    """
    kinds: dict[bool, list[str]] = {}
    if array is None:
        found = heads(spark, [(p, "json") for p in _paths(path)])
        for p in _paths(path):
            kinds.setdefault(found[p][0] == "array", []).append(p)
    else:
        kinds[array] = _paths(path)
    parts = [_read_json(spark, some, array, schema, corrupt_column) for array, some in kinds.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def file_format(path: str, declared: str | None = None) -> str:
    """Format used for a file: CSV wins, then Parquet, then JSON; CSV is the default."""
    fmt = (declared or "").lower()
    if fmt == "csv" or path.endswith(".csv"):
        return "csv"
    if fmt == "parquet" or path.endswith(".parquet"):
        return "parquet"
    if fmt in ("json", "ndjson") or path.endswith((".json", ".ndjson")):
        return "json"
    return "csv"


def upload_format(filename: str) -> str:
    """Format recorded at upload time, from the extension alone."""
    if filename.endswith(".parquet"):
        return "parquet"
    return "json" if filename.endswith((".json", ".ndjson")) else "csv"


def read_any(spark: SparkSession, path: str, declared: str | None = None, root: str | None = None) -> DataFrame:
    """Read a raw file in its declared or apparent format."""
    readers = {"csv": read_csv, "parquet": read_parquet, "json": read_json}
    return readers[file_format(path, declared)](spark, locate(path, root))


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBER = (*_WHOLE, T.FloatType, T.DoubleType, T.DecimalType)
_TIME = (T.DateType, T.TimestampNTZType, T.TimestampType)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds the values of both: numbers widen, dates become timestamps, all else is text.

    A long that meets a double becomes a decimal or text only by the caller's wish: it becomes double, as in a union.
    Records are joined field by field, lists and maps by what they hold.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale, whole = max(a.scale, b.scale), max(a.precision - a.scale, b.precision - b.scale)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
    if isinstance(a, _NUMBER) and isinstance(b, _NUMBER):
        return T.DoubleType()
    if isinstance(a, _TIME) and isinstance(b, _TIME):
        return T.TimestampType() if T.TimestampType in (type(a), type(b)) else T.TimestampNTZType()
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return common_schema([a, b])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType), True)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(common_type(a.keyType, b.keyType), common_type(a.valueType, b.valueType), True)
    return T.StringType()


def common_schema(schemas: Sequence[T.StructType]) -> T.StructType:
    """All columns of the schemas in order of appearance, each with the common type."""
    types: dict[str, T.DataType] = {}
    for f in (f for s in schemas for f in s.fields):
        types[f.name] = common_type(types[f.name], f.dataType) if f.name in types else f.dataType
    return T.StructType([T.StructField(n, t, True) for n, t in types.items()])


def _fitted(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value of one type as another that holds it; fields a record lacks become null."""
    if have == want:
        return column
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        own = {f.name: f.dataType for f in have.fields}
        fields = [(_fitted(column[f.name], own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name)
                  for f in want.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(column, lambda x: _fitted(x, have.elementType, want.elementType))
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast(want)


def read_union_by_name(spark: SparkSession, path: Paths) -> DataFrame:
    """Parquet files of differing schemas; a column a file lacks reads as null, conflicting types meet in a common one.

    The footers of all files are read in one job. Files of one schema are scanned together with their own types, so
    filters still reach the scan; each such group is cast and the groups are united.
    """
    files = [f for p in _paths(path) for f in files_below(spark, p)]
    found = heads(spark, [(f, "parquet") for f in files])
    groups: dict[str, list[str]] = {}
    for f in files:
        groups.setdefault(found[f][1], []).append(f)
    parts = [spark.read.parquet(*some) for some in groups.values()]
    if not parts:
        return spark.read.parquet(*_paths(path))
    schema = common_schema([p.schema for p in parts])

    def shaped(part: DataFrame) -> DataFrame:
        own = {f.name: f.dataType for f in part.schema.fields}
        return part.select(*[
            (_fitted(F.col(f"`{f.name}`"), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields])

    return reduce(DataFrame.unionAll, map(shaped, parts))
