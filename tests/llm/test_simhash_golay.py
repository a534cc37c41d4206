import random

import numpy as np
import xxhash

from silverbrook.llm import simhash_golay as sg
from silverbrook.llm.queries import QUERIES


def plain_fingerprint(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """doc -> smallest doc reachable over fingerprints at most two bits apart."""
    found = dict.fromkeys(prints.values())
    fps, seen, groups = sorted(found), set(), []
    for start in fps:
        if start in seen:
            continue
        todo, group = [start], {start}
        while todo:
            x = todo.pop()
            near = [y for y in fps if y not in group and (x ^ y).bit_count() <= 2]
            group.update(near)
            todo.extend(near)
        seen |= group
        groups.append(group)
    low = {}
    for g in groups:
        ids = [d for d, f in prints.items() if f in g]
        low.update(dict.fromkeys(ids, min(ids)))
    return low


def test_words_two_bits_apart_share_a_codeword():
    rng = random.Random(5)
    for _ in range(300):
        x = rng.getrandbits(23)
        y = x ^ 1 << rng.randrange(23) ^ 1 << rng.randrange(23)
        a, b = (set(sg.indices(np.array([v]))[0].tolist()) for v in (x, y & (1 << 23) - 1))
        assert len(a) in (1, 6) and a & b


def test_fingerprints_two_bits_apart_share_a_key():
    rng = random.Random(6)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for _ in range(rng.randrange(3)):
            y ^= 1 << rng.randrange(64)
        a, b = (set(k.tolist()) for k in sg.keys(np.array([x, y], np.uint64).view(np.int64)))
        assert a & b


def test_all_documents_against_brute_force(spark, small):
    rows = QUERIES["op10_simhash_near_dedup"](spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints)
    assert all(len(r.fingerprint) == 16 == len(r.fingerprint.strip().lower()) for r in rows)


def test_links_of_crowds_and_chains(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(12):  # crowds around a centre, chains, and loners
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
        for _ in range(15):
            centre ^= 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
            fps.add(centre)
    fps |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, 1 << 63}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    edges = sg.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node: r.component for r in sg.components(edges).collect()}
    want = plain_components({f: f % (1 << 64) for f in signed})
    assert {f: got.get(f, f) for f in signed} == want


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (4, "a B"), (5, "a b"), (6, "x " * 200_000), (7, "X"),
            (None, "lone words here now"), (8, "Ä b c d"), (9, "ä b c d")]
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in sg.near_duplicates(docs_of(rows)).collect())
    assert len(got) == len(rows)
    by = {d: (f, c) for d, f, c in got}
    assert by[1] == by[2] == by[3] == ("0" * 16, 1)
    assert by[4][1] == by[5][1] == 4
    assert by[0][1] is None
    assert int(by[8][0], 16) == plain_fingerprint("Ä b c d")
    assert sg.near_duplicates(docs_of([])).collect() == []
    wide = docs_of([(1, "a b c", 5, "z"), (2, "a b c", 6, None)], "doc_id long, text string, _fp int, component_id string")
    kept = sg.representatives(wide)
    assert kept.columns == wide.columns and [r.doc_id for r in kept.collect()] == [1]
