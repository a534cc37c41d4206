import random
import time

import xxhash
from pyspark.sql import functions as F

from silverbrook.llm import common
from silverbrook.llm import line_dedup as ld
from silverbrook.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(spark, docs):
    """doc -> removed line numbers, by the edit similarity of all pairs of normalised lines."""
    rows = ld.lines(docs).collect()
    norms = sorted({r.norm for r in rows})
    words = [n.split(" ") for n in norms]
    head = list(range(len(norms)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(norms)):
        for j in range(i):
            longest = max(len(words[i]), len(words[j]))
            if 5 * abs(len(words[i]) - len(words[j])) <= longest and 5 * distance(words[i], words[j]) <= longest:
                head[root(i)] = root(j)
    first, group = {}, {n: root(i) for i, n in enumerate(norms)}
    for r in rows:
        g = group[r.norm]
        first[g] = min(first.get(g, (r.doc_id, r.line_no)), (r.doc_id, r.line_no))
    gone = {}
    for r in rows:
        if (r.doc_id, r.line_no) != first[group[r.norm]]:
            gone.setdefault(r.doc_id, set()).add(r.line_no)
    return gone


def agrees(got, texts, gone):
    assert len(got) == len(texts)
    for r in got:
        want = texts[r.doc_id]
        lines = [] if want is None else want.split("\n")
        out = gone.get(r.doc_id, set())
        assert r.text == (None if want is None else "\n".join(x for i, x in enumerate(lines) if i not in out))
        assert (r.n_lines, r.n_removed) == (len(lines), len(out))


def near_lines(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = []
    for i in range(30):
        lines = []
        for j in range(4):
            base = random.Random(j).choices(["red", "blue", "green", "grey", "pink", "gold"], k=90)
            for _ in range(rng.randrange(3)):
                base[rng.randrange(90)] = word()
            lines.append(" ".join(base))
        lines += [" ".join(word() for _ in range(8)), "", "Same LINE, again!", "same line again"]
        docs.append((i, "\n".join(lines)))
    return docs


def test_against_all_pairs(spark, docs_of):
    docs = near_lines()
    frame = docs_of(docs)
    want = plain(spark, frame)
    assert sum(map(len, want.values())) > 60
    agrees(ld.dedup_lines(frame).collect(), dict(docs), want)
    distinct = ld.described(ld.lines(frame).selectExpr("xxhash64(norm) k", "norm").distinct()).cache()
    one, many = (dict((r.node, r.component) for r in ld.components(ld.links(distinct, heads)).collect()) for heads in (1, 500))
    assert one == many  # crowds lose no link


def test_all_documents(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    agrees(ld.dedup_lines(frame).collect(), texts, plain(spark, frame))
    assert QUERIES["op8_line_dedup"](spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()


def simhash(words):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    value = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return value - (1 << 64) if value >> 63 else value


def test_segments_are_majorities_of_their_words(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(n)) for n in (1, 3, 4, 5, 6, 7, 10, 29, 30, 37, 38, 300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, norm string")
    for r in ld.described(frame).select("*", ld.symbols(frame.norm).alias("symbols")).collect():
        w = texts[r.k].split(" ")
        two, three, four = (sorted({simhash(w[i:i + n]) for i in range(len(w) - n + 1)}) for n in (2, 3, 4))
        n = len(w)
        want = four[:8] if n > 37 else three[:4] + four[:4] if n > 29 else three[:6] if n > 6 else {*three, *two} if n > 3 else []
        assert sorted(r.segments) == sorted(want), w
        assert r.words == len(r.symbols) == n
        assert [r.symbols[i] == r.symbols[0] for i in range(n)] == [x == w[0] for x in w]


def test_odd_rows(spark, docs_of):
    docs = [(1, None), (2, ""), (3, "\n\n!!"), (4, "one two\nOne, two"), (5, "one two"), (5, "one two"), (None, "one two"),
            (6, "z " * 50_000 + "\nq")]
    got = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in ld.dedup_lines(docs_of(docs)).collect()), key=repr)
    assert got == sorted([(1, None, 0, 0), (2, "", 1, 0), (3, "\n\n!!", 3, 0), (4, "one two", 2, 1), (5, "", 1, 1), (5, "", 1, 1),
                          (0, "one two", 1, 0), (6, docs[-1][1], 2, 0)], key=repr)
    assert ld.dedup_lines(docs_of([])).collect() == []
    wide = docs_of([(1, "a\na", 5, "k", 9)], "doc_id long, text string, gone int, component string, n_lines int")
    assert [(r.text, r.gone, r.component, r.n_lines) for r in ld.dedup_lines(wide).collect()] == [("a", 5, "k", 2)]


def edited(line, edits, rng, word):
    line = list(line)
    for _ in range(edits):
        at = rng.randrange(len(line))
        line[at:at + 1] = rng.choice([[word()], [word(), line[at]], []])
    return line


def joined(pairs, n):
    """Smallest index reachable, per index."""
    head = list(range(n))
    for i, j in sorted(pairs):
        a, b = head[i], head[j]
        head = [min(a, b) if h in (a, b) else h for h in head]
    return head


def test_edit_similarity_alone(spark):
    """All pairs by edit similarity: none lost up to eight words, at least nine in ten of any length, none invented.

    Lines have as many edits as similarity 0.8 allows. With one head nearly all go through double keys, where
    only lines up to eight words are sure to lose nothing.
    """
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 3, 6])))
    lines, lengths = [], (3, 4, 5, 6, 7, 9, 10, 11, 14, 15, 20, 27, 33, 40, 50, 75, 100)
    for n in lengths:
        for _ in range(8):
            base = [word() for _ in range(n)]
            lines += [(n, tuple(x)) for x in [base] + [edited(base, n // 5, rng, word) for _ in range(4)]]
    lines = sorted(dict.fromkeys(lines))
    near = {(i, j) for i, (n, a) in enumerate(lines) for j, (m, b) in enumerate(lines[:i])
            if m == n and 5 * abs(len(a) - len(b)) <= max(len(a), len(b)) and 5 * distance(a, b) <= max(len(a), len(b))}
    frame = ld.described(spark.createDataFrame([(i, " ".join(x)) for i, (_, x) in enumerate(lines)], "k long, norm string")).cache()
    want = joined(near, len(lines))
    for heads in (1, ld.HEADS):
        got = {(r.u, r.v) for r in ld.links(frame, heads).collect()}
        for i, j in got:
            a, b = lines[i][1], lines[j][1]
            assert 5 * distance(a, b) <= max(len(a), len(b))
        group = joined(got, len(lines))
        for n in lengths:
            pairs = [(i, j) for i, j in near if lines[i][0] == n]
            found = sum(group[i] == group[j] for i, j in pairs)
            print(heads, n, len(pairs), found)
            assert found >= (1 if n <= 8 else 0.9 if heads > 1 else 0) * len(pairs), n
        assert all(group[i] == want[i] for i, (n, _) in enumerate(lines) if n <= 8)


def test_crowds_of_one_shared_segment(spark):
    """Similar lines that have one offered segment in common, which many other lines hold too, are linked."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    bases = [[word() for _ in range(40)] for _ in range(25)]
    lines = [" ".join(x) for base in bases for x in (base, edited(base, 4, rng, word))]
    rows = ld.described(spark.createDataFrame(list(enumerate(lines)), "k long, norm string"))
    # One offered segment each: the same for all.
    frame = rows.selectExpr("k", "norm", "words", "sketch", "array(7L) segments").cache()
    split = [x.split(" ") for x in lines]
    near = {(i, j) for i, a in enumerate(split) for j, b in enumerate(split[:i])
            if 5 * abs(len(a) - len(b)) <= max(len(a), len(b)) and 5 * distance(a, b) <= max(len(a), len(b))}
    assert len(near) == len(bases)
    for heads in (1, 4):
        assert {(r.u, r.v) for r in ld.links(frame, heads).collect()} == near


def test_lines_with_a_common_passage(spark, monkeypatch):
    """Lines two thirds of which are one passage, or one word again and again, are not compared as all pairs; no link is lost."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(40)]
    lines = [[*(passage if i % 2 else ["the"] * 40), *(word() for _ in range(20))] for i in range(80)]
    lines += [edited(x, 4, rng, word) for x in lines[:6]]
    rows = ld.described(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "k long, norm string"))
    frame = rows.selectExpr("k", "norm", "words", "sketch", "array(7L) segments").cache()
    near = {(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines[:i])
            if 5 * abs(len(a) - len(b)) <= max(len(a), len(b)) and 5 * distance(a, b) <= max(len(a), len(b))}
    assert len(near) == 6
    rest, keep = [], ld.materialize
    monkeypatch.setattr(ld, "materialize", lambda df, label: (rest.append(df.count()) if label == "line-late" else None, keep(df, label))[1])
    assert {(r.u, r.v) for r in ld.links(frame, 4).collect()} == near
    assert rest and sum(rest) <= len(lines)


def test_word_pairs_are_not_shuffled(spark, monkeypatch):
    """The word pairs of crowded lines get their counts and places where the lines are; only lines and counts move."""
    rng = random.Random(10)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(20)) for _ in range(30)]
    rows = ld.described(spark.createDataFrame(list(enumerate(lines)), "k long, norm string"))
    frame = rows.selectExpr("k", "norm", "words", "sketch", "array(7L) segments").cache()
    plans, keep = {}, ld.materialize
    monkeypatch.setattr(ld, "materialize", lambda df, label: (
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()), keep(df, label))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ld.links(frame, 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plans["line-rarest"].split("Generate explode", 1)[0]
    assert "Window" in above and "hashpartitioning" not in above


def test_small_crowds_meet_as_they_are(spark, monkeypatch):
    """Lines of a key that has fewer than heads squared of about one length need no word pairs; no link is lost."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    bases = [[word() for _ in range(n)] for n in (4, 5, 9, 10, 20, 24, 25, 30, 40, 50, 60, 100) for _ in range(5)]
    lines = [" ".join(x) for base in bases for x in (base, edited(base, len(base) // 5, rng, word))]
    lines += [" ".join(base[:-(len(base) // 5)]) for base in bases if len(base) % 5 == 0]
    lines = sorted(set(lines))
    rows = ld.described(spark.createDataFrame(list(enumerate(lines)), "k long, norm string"))
    frame = rows.selectExpr("k", "norm", "words", "sketch", "array(7L) segments").cache()
    split = [x.split(" ") for x in lines]
    near = {(i, j) for i, a in enumerate(split) for j, b in enumerate(split[:i])
            if 5 * abs(len(a) - len(b)) <= max(len(a), len(b)) and 5 * distance(a, b) <= max(len(a), len(b))}
    rest, keep = [], ld.materialize
    monkeypatch.setattr(ld, "materialize", lambda df, label: (rest.append(df.count()) if label == "line-open" else None, keep(df, label))[1])
    got = {(r.u, r.v) for r in ld.links(frame).collect()}
    assert got <= near and joined(got, len(lines)) == joined(near, len(lines))
    assert rest == [0]


def test_lines_of_one_group_do_not_meet_again(spark):
    """Rows of a component that is known already give no pairs, those of others do."""
    rows = [(1, k, 20, 0, 1 if k < 9 else 9) for k in range(1, 10)]
    frame = spark.createDataFrame(rows, "key long, k long, words int, sketch long, component long")
    assert {(r.u, r.v) for r in ld._meetings(frame, 500)[0].collect()} == {(9, k) for k in range(1, 9)}
    assert ld._meetings(frame.drop("component"), 500)[0].count() == 36


def test_a_longer_line_has_fewer_parities_to_differ_in(spark):
    """Eight words taken off and four replaced are twelve edits, though only sixteen words differ."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(40)]
    taken, both = base[:32], base[:28] + [f"x{i}" for i in range(4)]
    frame = ld.described(spark.createDataFrame([(0, " ".join(base)), (1, " ".join(taken)), (2, " ".join(both))], "k long, norm string"))
    other = frame.selectExpr("k v", "words wordsv", "sketch sketchv")
    assert {(r.k, r.v) for r in frame.join(other, frame.k < other.v).where(ld._near()).collect()} == {(0, 1), (1, 2)}
    for _ in range(20):
        line = [f"w{rng.randrange(30)}" for _ in range(40)]
        pair = ld.described(spark.createDataFrame([(0, " ".join(line)), (1, " ".join(edited(line, 8, rng, lambda: "y")))], "k long, norm string"))
        assert pair.where("k = 0").crossJoin(pair.where("k = 1").selectExpr("words wordsv", "sketch sketchv")).where(ld._near()).count() == 1


def test_shuffle_files_go_with_the_step(spark):
    """A stored step leaves no shuffle files behind, and the session's setting is as before."""
    blocks = lambda: [b for b in map(str, spark._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split(" "))
                      if b.startswith("shuffle_")]
    before, had = spark.conf.get(common.SHUFFLE_CLEANUP), set(blocks())
    stored = common.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "cleanup")
    deadline = time.time() + 20
    while set(blocks()) - had and time.time() < deadline:
        time.sleep(0.2)
    assert not set(blocks()) - had and spark.conf.get(common.SHUFFLE_CLEANUP) == before
    assert stored.count() == 7


def test_a_pair_meets_once_in_the_last_step(spark, monkeypatch):
    """Lines that share several keys give one row, not one per key; more keys than are carried lose nothing."""
    rows = [(key, k, 20, 0, k) for k in range(6) for key in range(5)]
    left = spark.createDataFrame(rows, "key long, k long, words int, sketch long, component long")
    known = spark.range(6).selectExpr("id k", "array(0L, 0L, 0L, 0L) wide")
    want = {(u, v) for u in range(6) for v in range(u)}
    once = [(r.u, r.v) for r in ld._across(left, known).collect()]
    assert set(once) == want and len(once) <= 2 * len(want)  # lines outside the main group meet from either side
    monkeypatch.setattr(ld, "KEYS", 4)
    assert {(r.u, r.v) for r in ld._across(left, known).collect()} == want
