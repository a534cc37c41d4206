import random
import re

import pytest
from llm_compare import agree

from silverbrook.llm import ngram_join as nj


def plain(rows):
    """All pairs of the rows."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and 100 * k >= 85 * (len(a) + len(sets[j]) - k):
                group[top(i)] = top(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[top(i)] = min(low.get(top(i), doc), doc)
    return sorted(((d, len(s), low.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))),
                  key=str)


def check(docs_of, rows):
    got = nj.jaccard_classes(docs_of(rows))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    want = plain(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    return want


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        at = rng.randrange(len(words) or 1)
        words[at:at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}" for _ in range(rng.randrange(2))]
    return words


def corpus(rng, groups, size, passage):
    rows, boiler = [], [f"b{i}" for i in range(passage)]
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 5, 12, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, size])):
            words = edited(rng, base, rng.choice([0, 1, 2, 4, 9]))
            if rng.random() < 0.4:
                at = rng.randrange(len(words) + 1)
                words[at:at] = boiler
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def test_with_sql(spark, small):
    agree(spark, small, "op11_ngram_jaccard")


def test_whole_table_against_all_pairs_that_share(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = nj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


@pytest.mark.parametrize(("long", "sample"), [(64, 4000), (4, 4000), (2, 10), (1, 0)])
def test_groups_passages_and_crowds(docs_of, monkeypatch, long, sample):
    monkeypatch.setattr(nj, "LONG", long)
    monkeypatch.setattr(nj, "SAMPLE", sample)
    want = check(docs_of, corpus(random.Random(long), 60, 12, 30))
    assert any(c != d for d, _, c in want)


def test_one_crowd_of_near_copies_without_its_base(docs_of, monkeypatch):
    monkeypatch.setattr(nj, "LONG", 8)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([1, 2, 3, 5])))) for i in range(150)]
    check(docs_of, rows)


def test_templates_share_nearly_all_long_lists(docs_of, monkeypatch):
    monkeypatch.setattr(nj, "LONG", 3)
    rng = random.Random(11)
    parts = [[f"p{k}x{i}" for i in range(15)] for k in range(10)]
    rows = [(i, " ".join(sum(rng.sample(parts, 8), []))) for i in range(80)]
    check(docs_of, rows)


def test_shuffled_partitions_and_recomputed_pieces(docs_of, monkeypatch):
    monkeypatch.setattr(nj, "BROADCAST", 0)
    rows = corpus(random.Random(5), 30, 5, 10)
    check(docs_of, rows)


def test_odd_rows(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "A b"), (4, "a B"), (5, "a b"), (None, "a b"), (None, "only here now ok"),
            (6, text), (6, text + " more"), (7, text.upper()), (7, "another text"), (8, "x " * 100_000), (9, "x x x x x"),
            (10, "Ä b c d"), (11, "ä b c d"), (-5, text + " less"), (12, "a b c"), (13, "a b c d"), (None, None)]
    check(docs_of, rows)
    assert nj.jaccard_classes(docs_of([])).collect() == []
    check(docs_of, [(1, None), (2, " ")])
    wide = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, sid int, token string")
    assert sorted(map(tuple, nj.jaccard_classes(wide).collect()), key=str) == plain(rows)
