"""Benchmark decontamination by Wu-Manber search for every window of every benchmark item.

The symbols are words. A table over blocks of two words tells how far the scan may jump; where it may not
jump, the hash of the block picks the windows that end in it, their first words are compared, and then all.
Windows are searched in groups of one length, because the jump depends on the shortest pattern.

Nulls and empty texts have no words. A null item_id takes no part. Repeated rows keep one result row each;
repeated items count once. Items without words are no windows. No benchmark: nothing is hit. Extra columns
are carried through ``contamination`` unless the result has a column of that name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverbrook.llm.common import materialize, rows_of, words

WINDOW = 13
# Windows held by an executor at once: about 250 bytes each. More windows are searched in further passes.
BLOCK_WINDOWS = 200_000


class WuManber:
    """Windows of one length, each with the items that contain it."""

    def __init__(self, length: int):
        self.length, self.shift, self.buckets = length, {}, {}
        self.size = min(2, length)  # words in a block

    def add(self, window: tuple[bytes, ...], item: int) -> None:
        m, b = self.length, self.size
        for end in range(b, m + 1):
            block, jump = window[end - b:end], m - end
            if self.shift.get(block, m) > jump:
                self.shift[block] = jump
        ending = self.buckets.setdefault(hash(window[m - b:]), {}).setdefault(window[:b], {})
        ending.setdefault(window, set()).add(item)

    def scan(self, text: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(first word, items) of every occurrence."""
        m, b, shift, buckets = self.length, self.size, self.shift, self.buckets
        free, end, last = m - b + 1, m, len(text)
        while end <= last:
            jump = shift.get(tuple(text[end - b:end]), free)
            if jump:
                end += jump
                continue
            start = end - m
            starts = buckets.get(hash(tuple(text[end - b:end])), {}).get(tuple(text[start:start + b]))
            if starts:
                found = tuple(text[start:end])
                if found in starts:  # equality of all words
                    yield start, starts[found]
            end += 1


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (item_id, window); a window is its words joined by blanks."""
    def cut(batches):
        for batch in batches:
            ids, out = [], []
            for item, text in rows_of([batch], "item_id", "text"):
                tokens = words(text)
                for i in range(max(1, len(tokens) - size + 1) if tokens else 0):
                    ids.append(item)
                    out.append(b" ".join(tokens[i:i + size]).decode())
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out)], ["item_id", "window"])
                        ids, out = [], []
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["item_id", "window"])

    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return items.mapInArrow(cut, "item_id long, window string").distinct()


RESULT = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(),
          "contaminated": pa.bool_()}
_SPAN = "struct<start:int,length:int,items:array<bigint>>"


def _verdict(n_words: int, found: list[dict], share: int) -> tuple:
    hit, upto, items = 0, 0, set()
    for o in sorted(found, key=lambda o: o["start"]):
        end = o["start"] + o["length"]
        hit += max(0, end - max(upto, o["start"]))
        upto = max(upto, end)
        items.update(o["items"])
    names = ",".join(sorted(map(str, items)))
    return n_words, hit, len(items), hashlib.sha256(names.encode()).hexdigest(), hit > 0 and share * hit >= n_words


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, size: int = WINDOW,
                  block: int = BLOCK_WINDOWS) -> DataFrame:
    """Each row of ``docs`` with its words, the words hit, the items found, and the verdict.

    Contaminated: some word is hit and ``share`` times the hit words reach the number of words. Windows are
    dealt by hash into passes of about ``block`` windows; each pass brings one part to the driver and the
    executors and writes the rows before the next begins, so memory has a fixed bound however large the benchmark
    is. Occurrences travel with the row, so the documents are never shuffled.
    """
    spark, found = docs.sparkSession, windows(benchmark, size).persist()
    passes = max(1, -(-found.count() // block))
    keep = [c for c in docs.columns if c not in [*RESULT, "_found"]]
    docs = docs.select(*keep)
    if passes > 1:
        docs = docs.withColumn("_found", F.array().cast(f"array<{_SPAN}>"))
    for part in range(passes):
        mine = found.where(F.pmod(F.xxhash64("item_id", "window"), F.lit(passes)) == part)
        patterns = spark.sparkContext.broadcast([(r.item_id, r.window) for r in mine.toLocalIterator()])
        last = part == passes - 1

        def search(batches, patterns=patterns, last=last):
            engines: dict[int, WuManber] = {}
            for item, window in patterns.value:
                key = tuple(window.encode().split(b" "))
                engines.setdefault(len(key), WuManber(len(key))).add(key, item)
            for batch in batches:
                out = []
                earlier = batch.column("_found").to_pylist() if passes > 1 else [[]] * batch.num_rows
                for (text,), before in zip(rows_of([batch], "text"), earlier, strict=True):
                    tokens = words(text)
                    spans = before + [{"start": at, "length": e.length, "items": list(items)}
                                      for e in engines.values() for at, items in e.scan(tokens)]
                    out.append(_verdict(len(tokens), spans, share) if last else spans)
                arrays = [batch.column(c) for c in keep]
                if last:
                    columns = list(zip(*out, strict=True)) or [[]] * len(RESULT)
                    arrays += [pa.array(c, t) for c, t in zip(columns, RESULT.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, [*keep, *RESULT])
                else:
                    arrays.append(pa.array(out, batch.schema.field("_found").type))
                    yield pa.RecordBatch.from_arrays(arrays, [*keep, "_found"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep)
        docs = docs.mapInArrow(search, schema + (
            ", n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
            if last else f", _found array<{_SPAN}>"))
        if not last:
            docs = materialize(docs, "decontamination-pass")
            patterns.unpersist()
    found.unpersist()
    return docs


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    columns = docs.columns
    inner = [f"c{i}" if c != "text" else c for i, c in enumerate(columns)]
    judged = contamination(docs.toDF(*inner), benchmark)
    return judged.where(~F.col("contaminated")).select(*inner).toDF(*columns)
