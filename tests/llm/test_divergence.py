import random
import re
from collections import Counter, defaultdict

import numpy as np
from llm_compare import agree

from silverbrook.llm import divergence as dv

SCHEMA = "lang string, source string, text string"


def plain(rows, min_docs=10, top=10):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in df[lang].items() if c >= min_docs]
        sources = [s for x, s in groups if x == lang]
        whole = Counter()
        for s in sources:
            whole.update(n[lang, s])

        def share(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: share(n[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, some in (("pair", pairs), ("term", terms)):
                ranked = sorted(some, key=lambda r: (-r[0], r[1].encode()))[:None if part == "pair" else top]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def check(spark, rows, **options):
    got = dv.divergence(spark.createDataFrame(rows, SCHEMA), **options)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "string", "bigint", "int"]
    assert sorted(map(tuple, got.collect())) == plain(rows, **options)


def random_rows(rng, n, sources):
    vocabulary = ["the", "Éa", "z", "ab", "abc", *(f"{a}{b}x" for a in "abcdefghij" for b in "klmnopqrst")]
    return [(rng.choice(["en", "de", None]), f"s{rng.randrange(sources)}",
             " ".join(rng.choices(vocabulary, [1000 // (i + 1) + 1 for i in range(len(vocabulary))], k=rng.randrange(60))))
            for _ in range(n)]


def test_with_sql(spark, small):
    agree(spark, small, "op12_source_divergence")


def test_random_rows(spark):
    check(spark, random_rows(random.Random(1), 400, 6))


def test_many_sources_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dv, "SIDE", 3)
    monkeypatch.setattr(dv, "SLICE_TERMS", 10)
    check(spark, random_rows(random.Random(2), 300, 11), min_docs=2, top=3)


def test_partial_counts_are_flushed(spark, monkeypatch):
    monkeypatch.setattr(dv, "HELD", 5)
    check(spark, random_rows(random.Random(3), 60, 3), min_docs=2)


def test_skyband_keeps_what_few_dominate(spark):
    rng = random.Random(4)
    rows = [("en", f"s{rng.randrange(2)}", f"t{i:04}", rng.randrange(1, 30), rng.randrange(30, 60)) for i in range(5000)]
    frame = spark.createDataFrame(rows, "lang string, source string, term string, n long, lang_n long")
    got = {r.term for r in dv.skyband(frame, ["lang", "source"], 4).collect()}
    want = {r[2] for r in rows if sum(o[1] == r[1] and o[3] >= r[3] and o[4] <= r[4] and o[2] < r[2] for o in rows) < 4}
    assert got == want


def test_shares_are_exact():
    rng = random.Random(5)
    for _ in range(2000):
        total = rng.randrange(2, 9 * 10**13)
        count = rng.randrange(0, total - 1)
        assert dv.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 2) // total


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "", ""), ("en", "a", "one two"), ("en", "b", None), ("en", "c", "1 2 3"),
            ("de", "x", "Tie tie tie " * 20_000), *[("fr", s, "q r s t u v w x y z aa bb") for s in "mn" for _ in range(5)],
            *[("es", "one", "solo") for _ in range(12)]]
    check(spark, rows)
    check(spark, rows, min_docs=1, top=2)
    wide = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", id int, term string, n int")
    assert sorted(map(tuple, dv.divergence(wide).collect())) == plain(rows)
    assert dv.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
