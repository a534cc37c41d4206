"""Quality by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is built from text labelled good, one from text labelled bad. A whole text is compressed with
each, in pieces of ``PIECE`` bytes so that the dictionary counts everywhere and not only at the start; the
difference of the sizes over the length is one number, and a logistic curve fitted on labelled rows that built no
dictionary turns it into a probability. Dictionaries and curve come from bounded, documented samples of labelled
rows and are broadcast: at most two dictionaries of ``DICTIONARY`` bytes. Scoring passes once over the documents.

Null and empty texts have a difference of zero. Labels that are null are not used; a document with several labels
counts as good if one says so; repeated rows of a document are learned once. With labels of one kind, or none,
every score is the smoothed share of good labels. A null doc_id is never learned from and counts as held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverbrook.llm.common import crc_mod, fit_curve, rows_of

PER_CLASS = 800  # pieces of labelled text that a dictionary is built from, at most
PIECES = 6  # of one document, at most
CALIBRATION = 6_000  # labelled rows the curve is fitted on, at most
PIECE = 2048
DICTIONARY = 112_640
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    base: float = 0.0


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too few samples to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Sizes:
    """Compressed sizes of whole texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.sides = []
        for content in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        data = memoryview((text or "").encode())
        total = 0
        for at in range(0, len(data), PIECE):
            good, bad = (len(side.compress(data[at:at + PIECE])) for side in self.sides)
            total += bad - good
        return total / max(1, len(data))


def differences(docs: DataFrame, good: bytes, bad: bytes, name: str) -> DataFrame:
    """``docs`` without text and with the difference as column ``name``."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", name)]
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))

    def measure(batches):
        sizes = Sizes(*shared.value)
        for batch in batches:
            out = np.fromiter((sizes.difference(t) for (t,) in rows_of([batch], "text")), float, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(out)], [f.name for f in kept] + [name])

    return docs.select(*[f.name for f in kept], "text").mapInArrow(
        measure, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, per_class: int = PER_CLASS,
          calibration: int = CALIBRATION) -> Model:
    """A model from the labelled rows for which ``may_learn`` (a condition on doc_id) holds.

    Half of them, by a hash of the id, may build dictionaries, the other half the curve; of more rows than the
    bounds allow those with the smallest hash are used.
    """
    rows = labels.where(may_learn & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.max("quality").alias("label"))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(base=float(np.log(share / (1 - share))))
    order = [F.xxhash64("doc_id", F.lit(4)), F.col("doc_id")]
    half = F.pmod(F.xxhash64("doc_id", F.lit(40)), F.lit(2))
    pick = rows.where((half == 0) & (F.col("label") == 0)).orderBy(*order).limit(per_class).union(
        rows.where((half == 0) & (F.col("label") == 1)).orderBy(*order).limit(per_class)).withColumn("use", F.lit(0))
    pick = pick.union(rows.where(half == 1).orderBy(*order).limit(calibration).withColumn("use", F.lit(1)))
    texts = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")  # bounded by the sample sizes
    number = F.explode(F.sequence(F.lit(0), F.ceil(F.octet_length("text") / PIECE).cast("int") - 1))
    pieces = texts.where("use = 0 AND text <> ''").withColumn("at", number)
    piece = F.expr(f"substring(encode(text, 'UTF-8'), at * {PIECE} + 1, {PIECE})")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("at", "doc_id"), "at"))
    pieces = pieces.select("doc_id", "label", "at", piece.alias("piece")).dropDuplicates(["doc_id", "at"]).withColumn(
        "turn", turn).where(F.col("turn") <= PIECES)
    samples = [r for k in (0, 1) for r in pieces.where(F.col("label") == k).orderBy("turn", *order).limit(
        per_class).collect()]  # other documents first, then more of the same
    by_label = {k: [bytes(r.piece) for r in samples if r.label == k] for k in (0, 1)}
    good, bad = build_dictionary(by_label[1]), build_dictionary(by_label[0])
    curve = differences(texts.where("use = 1").select("doc_id", "label", "text"), good, bad, "x").groupBy("doc_id").agg(
        F.min("x").alias("x"), F.max("label").alias("y")).collect()
    if len({r.y for r in curve}) < 2:
        share = (counts[1] + 1) / (counts[0] + counts[1] + 2)
        return Model(good, bad, 0.0, float(np.log(share / (1 - share))))
    curve.sort()
    slope, base = fit_curve(np.array([r.x for r in curve]), np.array([float(r.y) for r in curve]))
    return Model(good, bad, slope, base)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` without text and with the probability of being good as column ``name``."""
    return differences(docs, model.good, model.bad, name).withColumn(
        name, 1 / (1 + F.exp(-(F.col(name) * model.slope + model.base))))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, text included, whose score reaches ``threshold``."""
    columns = docs.columns
    inner = [c if c == "text" else f"c{i}" for i, c in enumerate(columns)]
    again = docs.toDF(*inner).withColumn("copy", F.col("text"))
    kept = score(again, model).where(F.col("score") >= threshold).withColumnRenamed("copy", "text")
    return kept.select(*inner).toDF(*columns)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(column, 5) == 0, F.lit(True))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; a fifth of the ids is held out of training."""
    model = train(docs, labels, ~held_out())
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
