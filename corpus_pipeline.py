"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

Stages get and return the columns of ``documents``; the last returns packed pieces. A text that a stage changes gets
a new ``n_chars``. Nulls, empty texts, repeated rows and empty tables are handled as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverbrook.llm import decontaminate, line_dedup, pack, quality, simhash_golay
from silverbrook.llm.common import materialize, table, tokenizer_file


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    columns = docs.columns
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    return quality.keep_good(docs, model).select(*columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those with no line left go."""
    columns = docs.columns
    rest = line_dedup.dedup_lines(docs).where("n_removed < n_lines OR n_lines = 0")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rest.withColumn("n_chars", changed).select(*columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash_golay.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences."""
    return pack.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", one_of_each),
    ("decontamination", decontaminated),
    ("packing", packed),
]
# Training, fingerprint components and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
