"""The registered queries of this folder and the plain SQL each one must agree with, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from silverbrook.llm import (
    decontaminate, divergence, line_dedup, lm_score, ngram_join, pack, prefix_trie, quality, secrets, simhash_golay, topk,
    toxicity, warc,
)
from silverbrook.llm.common import table, tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_decontamination(spark, sf_dir):
    """Every document against every window of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


ORACLES["op3_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, w[i + 1 : i + n] AS win FROM (
    SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS i
    FROM (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (
  SELECT row_id, n, i, w[i + 1 : i + n] AS win FROM (
    SELECT row_id, w, n, unnest(range(0, len(w) - n + 1)) AS i
    FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT row_id, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT row_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
      FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (row_id) LEFT JOIN t USING (row_id)
"""


@query
def op10_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate group of every document."""
    docs = table(spark, sf_dir, "documents")
    return simhash_golay.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


@query
def op2_toxicity(spark, sf_dir):
    """Probability of every document that its label says toxic."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_quality(spark, sf_dir):
    """Probability of every document that its label says good."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_best_fit_packing(spark, sf_dir):
    """Every document cut, if it must be, and packed into sequences of 2,048 ids."""
    return pack.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op8_line_dedup(spark, sf_dir):
    """Every document without the lines that repeat an earlier one, exactly or nearly."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


@query
def op9_secrets(spark, sf_dir):
    """Candidate secrets of every document; owners are the sources, repositories the documents."""
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op5_exact_topk(spark, sf_dir):
    """The five best partners of every query vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op5_exact_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.rid <> b.rid AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op7_warc(spark, sf_dir):
    """Every page written to an archive and read back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


ORACLES["op7_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON n >= 100 AND p.d = f.d
"""


@query
def op1_lm_scores(spark, sf_dir):
    """Score of every document by the n-grams of all other documents."""
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def _secret_matches(kind: str) -> str:
    order, pattern, group, least = secrets.KINDS[kind]
    quoted = pattern.replace("'", "''")
    return f"""SELECT rid, source, '{kind}' AS kind, {order} AS ord, {least} AS least,
      regexp_extract_all(t, '{quoted}', 0) AS ms, regexp_extract_all(t, '{quoted}', {group}) AS vs,
      string_split_regex(t, '{quoted}') AS gaps FROM d"""


ORACLES["op9_secrets"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_secret_matches(k) for k in secrets.KINDS)}),
e AS (SELECT rid, source, kind, ord, least, i, ms[i] AS match, vs[i] AS value, gaps[i] AS gap
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)),
p AS (SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM e),
s AS (SELECT rid, source, kind, ord, CAST(stop - length(match) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, value
      FROM p WHERE length(value) >= least AND (kind <> 'opaque' OR (regexp_matches(value, '[0-9]')
        AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')))),
f AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners FROM s GROUP BY 1),
j AS (SELECT s.*, owners < {secrets.EXAMPLE_OWNERS} AS live,
        kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR) AS span
      FROM s JOIN f USING (value) WHERE kind <> 'opaque' OR owners < {secrets.EXAMPLE_OWNERS}),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example,
        string_agg(span, ',' ORDER BY start, ord) AS spans,
        string_agg(span, ',' ORDER BY start, ord) FILTER (kind <> 'opaque') AS base FROM j GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (rid)
"""


@query
def op13_prefix_trie(spark, sf_dir):
    """Every node of the prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           coalesce(text, '')) AS pos, coalesce(role, '') AS r, coalesce(text, '') AS x,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
z AS (
  SELECT c, count(*) AS l, c - c % 20 AS b, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
           lambda a, s: list_reduce([xor(a, s), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 4 AS BIGINT) AS h
  FROM t GROUP BY c),
reb AS (
  SELECT z.c, t.pos, r, x, w FROM z JOIN t ON t.c = z.b AND t.pos <= z.h
  UNION ALL
  SELECT z.c, t.pos - z.h + least(z.h, coalesce(f.l, 0)), r, x, w
  FROM z JOIN t ON t.c = z.c AND t.pos > z.h LEFT JOIN z f ON f.c = z.b),
p AS (
  SELECT c, pos AS d, list({'r': r, 'x': x}) OVER (PARTITION BY c ORDER BY pos) AS k, w FROM reb
  UNION ALL SELECT c, 0, [], 0 FROM z),
e AS (SELECT c, max(d) AS len FROM p GROUP BY c),
n AS (SELECT d, k, min(c) AS m, count(*) AS n, max(w) AS w FROM p GROUP BY d, k),
a AS (SELECT p.c, p.d, n.m, n.n, n.w, e.len FROM p JOIN n USING (d, k) JOIN e USING (c)),
u AS (SELECT DISTINCT d, m, n, w FROM a),
up AS (SELECT u.d, u.m, a.m AS pm FROM u JOIN a ON a.c = u.m AND a.d = u.d - 1),
ch AS (SELECT d - 1 AS d, pm AS m, count(*) AS n_children FROM up GROUP BY 1, 2),
sub AS (
  SELECT a.d, a.m, sum((u.n - 1) * u.w) AS saved, count(*) FILTER (ch.m IS NULL) AS n_leaves
  FROM u JOIN a ON a.c = u.m AND a.d <= u.d LEFT JOIN ch ON ch.d = u.d AND ch.m = u.m GROUP BY 1, 2),
en AS (SELECT d, m, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM a WHERE d = len GROUP BY 1, 2)
SELECT u.m AS conv_id, CAST(u.d AS BIGINT) AS depth, pm AS parent_conv_id, u.n AS n_convs,
       CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM u LEFT JOIN up USING (d, m) LEFT JOIN ch USING (d, m) JOIN sub USING (d, m) LEFT JOIN en USING (d, m)
"""


@query
def op12_source_divergence(spark, sf_dir):
    """Every source of a language against the others, and the ten terms that make it stand out."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM o GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
l AS (SELECT lang, count(*) AS v, sum(ln) AS ltotal FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.ln + 2)) // (l.ltotal + 2 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM p x JOIN p y USING (lang, term)
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM r WHERE part = 'pair' OR rank <= 10
"""


@query
def op11_ngram_jaccard(spark, sf_dir):
    """Groups of documents whose sets of four-word shingles are alike."""
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


ORACLES["op11_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, CASE WHEN len(w) < 4 THEN w ELSE w[i + 1 : i + 4] END AS g
      FROM (SELECT rid, w, unnest(range(0, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(doc_id) AS component_id FROM r JOIN d ON d.rid = r.y GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n USING (rid) JOIN c ON c.x = d.rid
"""
