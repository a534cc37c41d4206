import hashlib
import random
import re

from silverbrook.llm import decontaminate as dc
from silverbrook.llm.queries import QUERIES


def plain(docs, items):
    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
            chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    wins = {(i, tuple(w[k:k + 13])) for i, t in items if i is not None for w in [tokens(t)] if w
            for k in range(max(1, len(w) - 12))}
    out = []
    for d, t in docs:
        w, hit, found = tokens(t), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found.add(i)
        names = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def shown(df):
    return sorted((tuple(r[c] for c in ("doc_id", *dc.RESULT)) for r in df.collect()), key=repr)


def test_small_alphabet_against_brute_force(spark, docs_of):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "ab", "é", "7"])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(120)]
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 14, 20])))) for i in range(25)]
    items += [(100, docs[3][1]), (101, docs[4][1].upper()), (102, None), (None, docs[5][1]), (100, docs[3][1])]
    bench = docs_of(items, "item_id long, text string")
    want = plain(docs, items)
    assert shown(dc.contamination(docs_of(docs), bench)) == want
    assert shown(dc.contamination(docs_of(docs), bench, block=40)) == want  # several passes


def test_odd_rows(spark, docs_of):
    long = "x y z " * 60_000
    docs = [(1, None), (2, ""), (3, "...!"), (None, "one two"), (4, long), (4, long), (5, "One, TWO!")]
    items = [(7, "one two"), (8, "z x"), (9, ""), (10, None)]
    bench = docs_of(items, "item_id long, text string")
    got = dc.contamination(docs_of(docs), bench)
    assert shown(got) == plain(docs, items)
    empty = docs_of([], "item_id long, text string")
    assert not any(r.contaminated for r in dc.contamination(docs_of(docs), empty).collect())
    assert dc.contamination(docs_of([]), bench).collect() == []
    clash = docs_of([(1, "one two", 5, "k"), (2, "three", 6, None)], "doc_id long, text string, n_hit int, `we ird` string")
    kept = dc.clean(clash, bench)
    assert kept.columns == clash.columns and [tuple(r) for r in kept.collect()] == [(2, "three", 6, None)]


def test_query_agrees_with_sql(spark, small):
    from llm_compare import agree

    agree(spark, small, "op3_decontamination")
    assert any(r.contaminated for r in QUERIES["op3_decontamination"](spark, small).collect())


def test_one_pass_in_memory_at_a_time(spark, docs_of):
    docs = [(i, f"w{i} w{i + 1} w{i + 2}") for i in range(20)]
    items = [(i, f"w{i} w{i + 1}") for i in range(0, 20, 2)]
    got = dc.contamination(docs_of(docs), docs_of(items, "item_id long, text string"), block=3)
    assert shown(got) == plain(docs, items)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # earlier passes are tables
