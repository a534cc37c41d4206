"""Large CSV files with line breaks inside quotes, read in many tasks.

Where a record starts depends on the quotes before it, so a task that gets a block from the middle of a file
cannot tell. A first pass finds for every block in which state, inside quotes or outside, it leaves a reader
that enters it in either state. Composing these small tables in file order, a prefix scan over blocks, gives the
state at the start of each block. A second pass cuts every block into records; the few that reach over a block's
end are put together from their pieces. Spark parses the records.

A quote opens only at the start of a cell, as in Spark's parser. Lines end with a line feed; where the first line of a
file has a carriage return before it, all lines of that file do, and line breaks in its cells become line feeds. Blank
lines between records are left out. The first record of each file is its header.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLOSE = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
_PIECES = "file string, block long, kind int, record string"
RECORD, HEAD, TAIL, HEADER_TAIL = range(4)


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a reader that enters the line inside or outside quotes leaves it inside quotes."""
    at = 0
    while True:
        if inside:
            closed = _CLOSE.match(line, at)
            if closed is None:
                return True
            inside, at = False, closed.end()
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(sep, at) + len(sep)
        if at < len(sep):
            return False


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with their file and the offset of the block that holds them, in file order within a task."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """(file, block) and lines, for each run of lines of one block."""
    for batch in batches:
        file, block = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        start = 0
        while start < len(file):
            end = start + 1
            while end < len(file) and block[end] == block[start] and file[end] == file[start]:
                end += 1
            yield (file[start], block[start]), batch.column("value").slice(start, end - start)
            start = end


def block_states(spark: SparkSession, paths: list[str], sep: str = ",") -> DataFrame:
    """Rows (file, block, inside, broken, returns), one for each block: the state at its start; whether any record of the
    file holds a line break; whether the lines of the file end with a carriage return."""
    def scan(batches):
        table: dict[tuple[str, int], list] = {}
        for key, lines in _runs(batches):
            first = key not in table and key[1] == 0 and len(lines) and lines[0].as_py().endswith("\r")
            state = table.setdefault(key, [False, True, False, bool(first)])
            for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
                before = state[0]
                state[:2] = [ends_inside(line, s, sep) for s in state[:2]]
                state[2] = state[2] or before or state[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in table], pa.string()), pa.array([k[1] for k in table], pa.int64()),
             *(pa.array([v[i] for v in table.values()], pa.bool_()) for i in range(4))],
            ["file", "block", "outside_to", "inside_to", "seen", "crlf"])

    found = _lines(spark, paths).mapInArrow(
        scan, "file string, block long, outside_to boolean, inside_to boolean, seen boolean, crlf boolean")
    # a block sends outside to a and inside to b: of the composition only the last block that sends both to one
    # state matters, and how many later ones swap the two
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("outside_to") == F.col("inside_to"), F.col("outside_to"))
    swaps = (F.col("outside_to") & ~F.col("inside_to")).cast("int")
    turned = F.sum(swaps).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("turned", turned).withColumn("fixed", F.when(
        fixed.isNotNull(), F.struct(fixed.alias("to"), "turned")))
    found = found.withColumn("last", F.last("fixed", ignorenulls=True).over(before)).withColumn(
        "so_far", F.coalesce(F.lag("turned").over(Window.partitionBy("file").orderBy("block")), F.lit(0)))
    odd = (F.col("so_far") - F.coalesce(F.col("last.turned"), F.lit(0))) % 2 == 1
    inside = F.coalesce(F.col("last.to"), F.lit(False)) != odd
    whole = Window.partitionBy("file")
    return found.select("file", "block", inside.alias("inside"), F.max(F.col("seen") | inside).over(whole).alias("broken"),
                        F.max("crlf").over(whole).alias("returns"))


def records(spark: SparkSession, paths: list[str], opened: set[tuple[str, int]], returns: set[str],
            sep: str = ",") -> DataFrame:
    """Rows (file, record) for every record but headers.

    ``opened`` holds the blocks that start inside quotes, ``returns`` the files whose lines end with a carriage return.
    """
    def cut(batches):
        at, part, head, header, inside, out = None, [], False, False, False, []

        def leave():
            if at is not None and part:
                out.append((*at, HEAD if head else HEADER_TAIL if header else TAIL, "\n".join(part)))

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))],
                ["file", "block", "kind", "record"])
            out.clear()
            return batch

        for key, lines in _runs(batches):
            if key != at:
                leave()
                at, part, head, header = key, [], key in opened, key[1] == 0
                inside = head
            quoted = pc.match_substring(lines, '"').to_pylist()
            crlf = key[0] in returns
            for line, has in zip(lines.to_pylist(), quoted, strict=True):
                if crlf:
                    line = line.removesuffix("\r")
                if has:
                    inside = ends_inside(line, inside, sep)
                if inside:
                    part.append(line)
                    continue
                text = "\n".join([*part, line]) if part else line
                if head:
                    out.append((*at, HEAD, text))
                elif text and header:
                    header = False
                elif text:
                    out.append((*at, RECORD, text))
                part, head = [], False
            yield flush()
        leave()
        yield flush()

    pieces = _lines(spark, paths).mapInArrow(cut, _PIECES)
    whole = pieces.where(F.col("kind") == RECORD).select("file", "record")
    order = Window.partitionBy("file").orderBy("block", "kind")
    chained = pieces.where(F.col("kind") != RECORD).withColumn("chain", F.sum(F.when(F.col("kind") == HEAD, 0).otherwise(1)).over(order))
    chained = chained.groupBy("file", "chain").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "kind", "record"))), lambda p: p["record"]),
                     "\n").alias("record"), F.max("kind").alias("kind"))
    return whole.unionByName(chained.where(F.col("kind") != HEADER_TAIL).select("file", "record"))
