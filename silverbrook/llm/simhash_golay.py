"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at
most two bits have a pair of segments in which one is equal and the other differs in at most one bit. So for
each ordered pair of segments a key is made of the equal one and a Golay codeword index of the other. The
(23,12) code is perfect: a word decodes to the one codeword within three bits. A segment's keys are the indices
of the codewords that it or a word one bit away decodes to, one or six in number, and words at most two bits
apart always share one. Equal keys propose candidates, the bit count decides.

Fingerprints are joined, not documents, so copies cost nothing. Keys shared by more than ``CROWD`` different
fingerprints are not joined; their fingerprints instead meet at the words one bit away: two fingerprints differ
in at most two bits exactly if some word is at most one bit from both, so a star around each such word holds all
their links without pairs, and nothing is lost.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverbrook.llm.common import components, materialize, rows_of

SEED = 42
SHINGLE = 3
MAX_BITS = 2
CROWD = 32
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Generator polynomial of the perfect binary Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


@lru_cache(maxsize=1)
def _decoder() -> np.ndarray:
    """For each 23-bit word the 12 message bits of the one codeword within distance three."""
    codewords = np.zeros(4096, np.int64)
    for bit in range(12):
        codewords[np.arange(4096) >> bit & 1 == 1] ^= GENERATOR << bit
    messages = np.arange(4096, dtype=np.int16)
    table = np.full(1 << 23, -1, np.int16)
    flips = [0]
    for i in range(23):
        flips.append(1 << i)
        for j in range(i):
            flips.append(1 << i | 1 << j)
            flips.extend(1 << i | 1 << j | 1 << k for k in range(j))
    for flip in flips:
        table[codewords ^ flip] = messages
    return table


def indices(segment: np.ndarray) -> np.ndarray:
    """Codeword indices of the segment and of its 23 neighbours, one row of 24 per segment."""
    near = segment[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
    return _decoder()[near]


def keys(fingerprints: np.ndarray) -> list[np.ndarray]:
    """Distinct join keys per signed 64-bit fingerprint."""
    parts = [(fingerprints.view(np.uint64) >> np.uint64(s)).astype(np.int64) & ((1 << n) - 1) for s, n in SEGMENTS]
    near = [np.sort(indices(p).astype(np.int64), axis=1) for p in parts]
    out = []
    for a in range(3):
        for b in range(3):
            if a != b:
                out.append((a * 3 + b) << 36 | parts[a][:, None] << 12 | near[b])
    return [np.unique(row) for row in np.concatenate(out, axis=1)]


def fingerprint(text: str | None, width: int = SHINGLE, step: int = 1 << 16) -> int:
    """Majority of the XXH64 bits of all shingles, repeats included; zero without words. Unsigned."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - width + 1)
    lo, hi = starts[:n].tolist(), ends[min(width, len(tokens)) - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, step):
        h = np.fromiter([digest(line[i:j], SEED) for i, j in zip(lo[at:at + step], hi[at:at + step], strict=True)],
                        "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * counts > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` without ``column`` and with ``_fp``, the fingerprint as a signed long."""
    kept = [f for f in docs.schema.fields if f.name not in (column, "_fp")]
    docs = docs.select(*[f.name for f in kept], column)

    def make(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t) for (t,) in rows_of([batch], column)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(values.view(np.int64))], [f.name for f in kept] + ["_fp"])

    return docs.mapInArrow(make, T.StructType([*kept, T.StructField("_fp", T.LongType())]))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) between the fingerprints of column ``fp`` (distinct longs) whose components equal those of all
    pairs at most two bits apart."""
    def explode_keys(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for at in range(0, len(fp), 1024):
                some = fp[at:at + 1024]
                found = keys(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(some, [len(k) for k in found])), pa.array(np.concatenate(found))], ["fp", "key"])

    keyed = materialize(distinct.mapInArrow(explode_keys, "fp long, key long"), "golay-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, "key"), "golay-shared")
    few = shared.where(F.col("n") <= CROWD).select("fp", "key")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    pairs = few.select(F.col("fp").alias("u"), "key").join(few.select(F.col("fp").alias("v"), "key"), "key").where(
        (F.col("u") > F.col("v")) & near).select("u", "v").distinct()
    crowd = shared.where(F.col("n") > CROWD).select("fp").distinct()
    meet = crowd.select("fp", F.explode(F.array(F.col("fp"), *[
        F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long")) for i in range(64)])).alias("at"))
    meet = meet.withColumnRenamed("fp", "u")
    centre = meet.groupBy("at").agg(F.min("u").alias("v"), F.count("*").alias("n")).where("n > 1").select("at", "v")
    return pairs.union(meet.join(centre, "at").where("u <> v").select("u", "v").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id, _fp) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most two bits. Null and empty texts and texts
    of blanks have fingerprint zero and are linked like any other. Repeated rows keep a row each. A null doc_id
    gets a row, but never names a component unless no document of it has an id. No documents: no rows.
    """
    prints = materialize(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    distinct = materialize(prints.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("low")), "distinct-fp")
    parts = components(links(distinct.select("fp")))
    classes = distinct.join(parts, distinct.fp == parts.node, "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = classes.join(lowest, "component").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(classes, "_fp").select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id", "_fp")


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one whose id names the component.

    Of repeated rows with that id all stay, and rows without an id stay.
    """
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id IS NULL").unionByName(docs.join(kept, "doc_id", "left_semi").select(*docs.columns))
