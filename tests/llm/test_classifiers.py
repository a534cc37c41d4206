import random
import zlib

import numpy as np
import pytest

from silverbrook.llm import quality as ql
from silverbrook.llm import toxicity as tx
from silverbrook.llm.common import WordHashes, fit_curve
from silverbrook.llm.queries import QUERIES

FOLDER = "sf0.01"


def ranked(pairs):
    """Probability that a positive scores above a negative."""
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


@pytest.mark.parametrize(("name", "label", "mod", "rest", "least"), [
    ("op2_toxicity", "toxic", 3, 1, 0.75), ("op4_quality", "quality", 5, 0, 0.95)])
def test_held_out_rows(spark, small, name, label, mod, rest, least):
    folder = small.replace("sf0.001", FOLDER)
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= (0.7 if label == "toxic" else 0.3)) for r in rows)
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert ranked([(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]) >= least


def made(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(60)]
        if bad:
            text[10:40:3] = ["vile", "scum"] * 5
        docs.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(bad)))
    return docs, labels


def test_planted_words_are_learned(spark, docs_of):
    docs, labels = made(2000)
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for rows, column in ((tx.toxicity(docs_of(docs), label).collect(), 2), (ql.quality(docs_of(docs), label).collect(), 1)):
        held = [(r.predicted, labels[r.doc_id][column]) for r in rows if r.held_out]
        assert np.mean([p == y for p, y in held]) > 0.95


def test_long_texts_are_hashed_in_overlapping_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = tx.features(text, WordHashes())
    monkeypatch.setattr(tx, "PIECE", 64)
    assert np.array_equal(whole, tx.features(text, WordHashes(50)))
    used = np.zeros(1 << tx.BITS, bool)
    used[whole[::3]] = True
    assert set(whole[::3]) == set(tx.features(text, WordHashes(), used=used)) | {0} & set(whole[::3])


def test_curve_is_fitted():
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    slope, base = fit_curve(x, y)
    assert abs(slope - 2) < 0.2 and abs(base + 1) < 0.2


@pytest.mark.parametrize(("op", "schema"), [(tx.toxicity, "toxic"), (ql.quality, "quality")])
def test_odd_rows(spark, docs_of, op, schema):
    docs = [(1, None), (2, ""), (3, "a " * 100_000), (4, "x"), (4, "x"), (None, "y z")]
    labels = lambda rows: spark.createDataFrame(rows, f"doc_id long, {schema} int")
    none = op(docs_of(docs), labels([])).collect()
    assert len(none) == 6 and {r.score for r in none} == {0.5}
    assert [r.held_out for r in none if r.doc_id is None] == [True]
    one = op(docs_of(docs), labels([(3, 1), (4, None), (None, 1), (4, 7), (2, 1), (1, 1)])).collect()
    assert len({r.score for r in one}) == 1 and 0.5 <= one[0].score < 1
    few = op(docs_of(docs), labels([(i, i % 2) for i in range(1, 5)] + [(1, 0)])).collect()
    assert len(few) == 6 and all(0 <= r.score <= 1 for r in few)
    assert op(docs_of([]), labels([(1, 1), (2, 0)])).collect() == []


def test_quality_filter_keeps_columns(spark, docs_of):
    docs, labels = made(400)
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    wide = docs_of([(i, t, 1.0, "c") for i, t in docs], "doc_id long, text string, score double, copy string")
    kept = ql.keep_good(wide, ql.train(wide, label, ~ql.held_out()))
    assert kept.columns == wide.columns
    rows = kept.collect()
    assert {r.doc_id: r.text for r in rows}.items() <= dict(docs).items() and 250 < len(rows) < 340
