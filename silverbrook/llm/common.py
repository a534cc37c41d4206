"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverbrook.session import scratch_path

__all__ = ["WordHashes", "components", "crc_mod", "fit_curve", "materialize", "mix", "rows_of", "table",
           "tokenizer_file", "words"]

# One byte each: digits, a-z and all bytes of non-ASCII characters stay, A-Z become a-z, the rest separates.
_WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


# Spark's setting to remove an execution's shuffle files when it has ended, not when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result, well compressed, to the shared folder and read it back.

    Later steps scan stored columns instead of repeating the work, and a lost executor costs no recomputation.
    Nothing reads the shuffles of the write again, so their files go with it.
    """
    path, conf = scratch_path(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the installed vocabulary package keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters, as UTF-8; null has none."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


class WordHashes(dict):
    """Memo of 64-bit word hashes, emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of two hash arrays."""
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29)))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo ``n``; null stays null."""
    return F.crc32(F.col(column).cast("string")) % n


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v): rows (node, component = smallest node).

    Alternates large-star and small-star steps, which shrink the diameter geometrically. Every round
    is written to the shared folder, so lineage stays short and lost executors cost one round. A hub's
    neighbours are never gathered: each step is a minimum per node, combined before the shuffle, and a
    join that may be split. Loops and repeated edges are allowed; no edges give no rows. Nulls are ignored.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.*").where("u <> v").distinct()
        edges = materialize(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and base of the logistic curve of largest likelihood, by Newton steps on the scaled difference."""
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -35, 35)))
        slope = design.T @ (y - p) - ridge * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Row tuples of the named columns, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)
