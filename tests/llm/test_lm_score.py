import math
import random
import re
from collections import Counter

import pytest

from silverbrook.llm import lm_score as lm
from silverbrook.llm.queries import QUERIES


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def grams(w):
    return Counter(tuple(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain(docs, corpus=None):
    own = corpus is None
    total = Counter()
    for _, t in corpus or docs:
        total += grams(tokens(t))
    words = sum(n for g, n in total.items() if len(g) == 1)
    out = []
    for d, t in docs:
        w = tokens(t)
        mine = grams(w) if own else Counter()
        c = lambda *g: total[g] - mine[g]
        rest, score, full = max(1, words - (len(w) if own else 0)), 0.0, 0
        for i, x in enumerate(w):
            if i >= 2 and c(w[i - 2], w[i - 1], x) > 0:
                s, full = c(w[i - 2], w[i - 1], x) / c(w[i - 2], w[i - 1]), full + 1
            elif i >= 1 and c(w[i - 1], x) > 0:
                s = (0.4 if i >= 2 else 1) * c(w[i - 1], x) / c(w[i - 1])
            else:
                s = 0.4 ** min(i, 2) * (c(x) or 0.4) / rest
            score += math.log10(s)
        out.append((d, len(w), full, pytest.approx(score, rel=1e-9, abs=1e-9)))
    return out


def shown(df):
    return sorted(tuple(r) for r in df.collect())


def some(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(25)))) for i in range(n)]


def test_corpus_scores_itself(spark, docs_of):
    docs = some(1, 60)
    for bucket, chunk in ((lm.BUCKET_WORDS, lm.CHUNK_WORDS), (20, 50)):  # one bucket and chunk, and many
        assert shown(lm.lm_scores(docs_of(docs), None, bucket, chunk)) == plain(docs)


def test_another_corpus(spark, docs_of):
    docs, corpus = some(2, 20), some(3, 40)
    assert shown(lm.lm_scores(docs_of(docs), docs_of(corpus), 30, 60)) == plain(docs, corpus)


def test_all_documents(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert shown(QUERIES["op1_lm_scores"](spark, small)) == plain(sorted(docs))


def test_odd_rows(spark, docs_of):
    docs = [(1, None), (2, ""), (3, "?!"), (4, "one"), (5, "One two"), (5, "one two"), (6, "w " * 3000)]
    assert shown(lm.lm_scores(docs_of(docs))) == plain(docs)
    wide = docs_of([(None, "x y", 1.5)], "doc_id long, text string, score double")
    assert [tuple(r)[:2] for r in lm.lm_scores(wide).collect()] == [(None, 2)]
    assert lm.lm_scores(docs_of([])).collect() == []
    assert shown(lm.lm_scores(docs_of(docs), docs_of([]))) == plain(docs, [(0, "")])
