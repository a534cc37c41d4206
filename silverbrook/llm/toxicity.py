"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashes of its words, of neighbouring words and of words with one between them,
each once. Every coordinate has its own learning rate, and L1 keeps at zero the weights that lack steady
evidence, so the model is a short list of (index, weight) that is broadcast; ``BITS`` bounds its size.

Features are made in parallel from whole texts. The updates depend on their order, so they run over a bounded,
documented sample of labelled rows that streams through one task, a row in memory at a time, in a few rounds. A
quarter of the sample is kept from the rounds; a logistic curve fitted there makes up for the shrinking of the
weights. Scoring passes once over whole texts and shuffles nothing.

Null and empty texts have no features and score by the bias alone. Labels that are null are not used; a document
with several labels counts as toxic if one says so; repeated rows of a document are learned once. Without labels,
or with labels of one kind, every score is the smoothed share of toxic labels. A null doc_id is never learned
from and counts as held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverbrook.llm.common import WordHashes, crc_mod, fit_curve, materialize, mix, rows_of, words

BITS = 20
SAMPLE = 12_000  # labelled rows used at most
ROUNDS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0
THRESHOLD = 0.7
# Texts are hashed in pieces of so many words; pieces overlap, so no n-gram is lost.
PIECE = 200_000


def features(text: str | None, hashes: WordHashes, bits: int = BITS, used: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct feature indices of a whole text, or those of them that are ``used``.

    Index 0 is the bias and always there.
    """
    tokens, found = words(text), [np.zeros(1, np.int64)]
    for at in range(0, len(tokens), PIECE):
        h = hashes.of(tokens[at:at + PIECE + 2])
        grams = np.concatenate([h, mix(h[:-1], h[1:]), mix(h[:-2], ~h[2:])]) >> np.uint64(64 - bits)
        grams = grams.astype(np.int64)
        found.append(np.unique(grams if used is None else grams[used[grams]]))
    return np.unique(np.concatenate(found))


@dataclass
class Ftrl:
    """Per-coordinate state; the weights follow from it."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls, bits: int = BITS) -> Ftrl:
        return cls(np.zeros(1 << bits), np.zeros(1 << bits))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, n = self.weights(at), self.n[at]
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    slope: float = 1.0
    base: float = 0.0
    bits: int = BITS


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = SAMPLE, rounds: int = ROUNDS,
          bits: int = BITS) -> Model:
    """A model from the labelled rows for which ``may_learn`` (a condition on doc_id) holds.

    Of more than ``sample`` such rows those with the smallest hash of the id are used.
    """
    spark, order = docs.sparkSession, [F.xxhash64("doc_id", F.lit(2)), F.col("doc_id")]
    rows = labels.where(may_learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").alias("label"))
    picked = rows.orderBy(*order).limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most ``sample`` small rows

    def extract(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [features(t, hashes, bits).astype(np.int32).tobytes() for (t,) in rows_of([batch], "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "at"])

    made = materialize(texts.mapInArrow(extract, "doc_id long, label int, at binary").groupBy("doc_id", "label").agg(
        F.min("at").alias("at")), "toxicity-sample")
    kinds = {r.label: r.n for r in made.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = (kinds.get(1, 0) + 1) / (sum(kinds.values()) + 2)
    model = Model(np.zeros(0, np.int64), np.zeros(0), 0.0, float(np.log(share / (1 - share))), bits)
    aside = F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(4)) == 0
    state = None
    for _ in range(rounds if len(kinds) == 2 else 0):
        shared = spark.sparkContext.broadcast(state)

        def learn(batches, shared=shared):
            mine = Ftrl.empty(bits)
            if shared.value:
                at, mine.z[at], mine.n[at] = shared.value
            for batch in batches:
                for label, at in rows_of([batch], "label", "at"):
                    mine.learn(np.frombuffer(at, np.int32), label)
            at = np.flatnonzero(mine.n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a.tobytes()]) for a in (at, mine.z[at], mine.n[at])], ["at", "z", "n"])

        r = made.where(~aside).coalesce(1).sortWithinPartitions(*order).mapInArrow(
            learn, "at binary, z binary, n binary").collect()[0]  # the state is bounded by 2^bits
        at = np.frombuffer(r.at, np.int64)
        state = at, np.frombuffer(r.z), np.frombuffer(r.n)
    if state is None:
        return model
    final = Ftrl.empty(bits)
    final.z[state[0]], final.n[state[0]] = state[1], state[2]
    weight = final.weights(slice(None))
    index = np.flatnonzero(weight)
    if not len(index):
        return model
    trained = Model(index, weight[index], bits=bits)
    curve = sorted((float(weight[np.frombuffer(r.at, np.int32)].sum()), r.label)
                   for r in made.where(aside).toLocalIterator())  # at most a quarter of the sample
    if len({y for _, y in curve}) == 2:
        trained.slope, trained.base = fit_curve(
            np.array([x for x, _ in curve]), np.array([float(y) for _, y in curve]))
    return trained


def margins(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` without text and with the sum of the weights of every whole text as column ``name``."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", name)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches):
        m, hashes = shared.value, WordHashes()
        weights = np.zeros(1 << m.bits)
        weights[m.index] = m.weight
        used = weights != 0
        for batch in batches:
            total = np.fromiter((weights[features(t, hashes, m.bits, used)].sum() for (t,) in rows_of([batch], "text")),
                                float, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(total)], [f.name for f in kept] + [name])

    return docs.select(*[f.name for f in kept], "text").mapInArrow(
        rate, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` without text and with the probability of being toxic as column ``name``."""
    return margins(docs, model, name).withColumn(
        name, 1 / (1 + F.exp(-(F.col(name) * model.slope + model.base))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; a third of the ids is held out of training."""
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(True))
    model = train(docs, labels, ~held)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
