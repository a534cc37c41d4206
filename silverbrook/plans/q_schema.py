"""Queries over type inference, schema matching and name suggestions."""

from pyspark.sql import functions as F

from silverbrook.functions import coltypes
from silverbrook.operators import name_suggest, schema_infer, schema_match
from silverbrook.plans import feeds
from silverbrook.plans.q_sources import dropped
from silverbrook.plans.registry import Tables, query

# Raw text columns of several kinds, with blanks.
RAW_TEXT = """
SELECT CAST(event_id AS STRING) AS id, CAST(value AS STRING) AS amount,
       substr(CAST(ts AS STRING), 1, 19) AS seen, event_type AS label,
       CASE WHEN value > 9 THEN 'NULL' ELSE CAST(user_id AS STRING) END AS maybe,
       CASE WHEN value > 9 THEN 'n/a' ELSE CAST(user_id AS STRING) END AS mixed,
       '0f8fad5b-d9cb-' || event_type AS token, '' AS nothing
FROM {events}"""

_KIND_SQL = """CASE WHEN regexp_matches(v, '^-?\\d+$') THEN 'bigint' WHEN regexp_matches(v, '^-?\\d*\\.\\d+$') THEN 'decimal'
  WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}') THEN 'timestamp'
  WHEN regexp_matches(v, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}') THEN 'uuid' ELSE 'varchar' END"""

INFER_SQL = f"""
WITH r AS ({RAW_TEXT}),
     v AS (SELECT 1 AS ordinal, 'id' AS name, id AS v FROM r UNION ALL SELECT 2, 'amount', amount FROM r
           UNION ALL SELECT 3, 'seen', seen FROM r UNION ALL SELECT 4, 'label', label FROM r
           UNION ALL SELECT 5, 'maybe', maybe FROM r UNION ALL SELECT 6, 'mixed', mixed FROM r
           UNION ALL SELECT 7, 'token', token FROM r UNION ALL SELECT 8, 'nothing', nothing FROM r),
     k AS (SELECT *, lower(v) IN ('', 'null') AS blank, {_KIND_SQL} AS kind FROM v)
SELECT ordinal, name, CASE WHEN count(DISTINCT kind) FILTER (NOT blank) = 1 THEN min(kind) FILTER (NOT blank)
         ELSE 'varchar' END AS type,
       bool_or(blank) AS nullable, coalesce(min(v) FILTER (NOT blank), '—') AS sample
FROM k GROUP BY 1, 2"""


@query("sch_infer_csv", INFER_SQL)
def sch_infer_csv(t: Tables):
    """Column types of raw CSV files, judged on every row."""
    path = dropped(t.sql(RAW_TEXT), t, "infer", "csv", header=True)
    return schema_infer.infer_text(t.spark.read.csv(path, header=True))


@query("sch_infer_first_row", """
WITH f AS (SELECT * FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)
SELECT 1 AS ordinal, 'o_orderkey' AS name, 'bigint' AS type, FALSE AS nullable, CAST(o_orderkey AS STRING) AS sample
FROM f UNION ALL SELECT 2, 'o_orderpriority', 'varchar', FALSE, o_orderpriority FROM f
UNION ALL SELECT 3, 'day', 'timestamp', FALSE, substr(CAST(o_orderdate AS STRING), 1, 10) FROM f""")
def sch_infer_first_row(t: Tables):
    """First-row mode on the orders, most expensive first."""
    rows = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").select(
        F.col("o_orderkey").cast("string"), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return schema_infer.infer_text(rows, mode="first_row")


JSON_SQL = f"""
WITH d AS (SELECT event_type, doc FROM ({feeds.JSON_RECORDS}) AS j),
     e AS (SELECT event_type, unnest(json_keys(doc)) AS name, doc FROM d),
     v AS (SELECT event_type, name, json_type(json_extract(doc, '$.' || name)) AS jt,
             json_extract_string(doc, '$.' || name) AS s FROM e),
     k AS (SELECT event_type, name, CASE WHEN jt = 'NULL' THEN NULL WHEN jt = 'BOOLEAN' THEN 'boolean'
             WHEN jt IN ('OBJECT', 'ARRAY') THEN 'json'
             WHEN jt = 'VARCHAR' THEN CASE WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'timestamp'
               WHEN regexp_matches(s, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}') THEN 'uuid' ELSE 'varchar' END
             WHEN CAST(s AS DOUBLE) = floor(CAST(s AS DOUBLE)) THEN 'bigint' ELSE 'double' END AS kind FROM v),
     n AS (SELECT event_type, count(*) AS n_docs FROM d GROUP BY 1)
SELECT k.event_type, name, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'varchar' END AS type,
       count(kind) < min(n_docs) AS nullable
FROM k JOIN n ON n.event_type = k.event_type GROUP BY 1, 2"""


@query("sch_infer_json", JSON_SQL)
def sch_infer_json(t: Tables):
    """Key types of JSON records per event type."""
    return schema_infer.infer_json(t.sql(feeds.JSON_RECORDS), "doc", ("event_type",))


CATEGORY_SQL = """CASE WHEN contains(lower({t}), 'int') THEN 'INTEGER'
  WHEN regexp_matches(lower({t}), 'double|float|decimal|numeric|real') THEN 'FLOAT'
  WHEN regexp_matches(lower({t}), 'time|date') THEN 'DATETIME' WHEN contains(lower({t}), 'bool') THEN 'BOOLEAN'
  WHEN contains(lower({t}), 'uuid') THEN 'UUID' WHEN contains(lower({t}), 'json') THEN 'JSON'
  WHEN regexp_matches(lower({t}), 'char|text|str') THEN 'STRING' ELSE 'OTHER' END"""


@query("sch_type_category", f"""
SELECT category, count(*) AS n, count(DISTINCT type) AS n_types
FROM (SELECT type, {CATEGORY_SQL.replace('{t}', 'type')} AS category FROM ({feeds.DATASET_COLUMNS}) AS c) AS k
GROUP BY 1""")
def sch_type_category(t: Tables):
    rows = feeds.dataset_columns(t).select("type", coltypes.type_category(F.col("type")).alias("category"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("type").alias("n_types"))


@query("sch_semantic_kind", f"""
WITH c AS (SELECT file_id, ordinal, name, CASE ordinal % 7 WHEN 0 THEN 'uuid' WHEN 1 THEN 'date'
             WHEN 2 THEN 'TIMESTAMP' WHEN 3 THEN 'INTEGER' WHEN 4 THEN 'double' WHEN 5 THEN 'STRUCT(x)'
             ELSE 'VARCHAR' END AS type FROM ({feeds.UPLOAD_COLUMNS}) AS u)
SELECT name, type, CASE WHEN lower(type) = 'uuid' OR lower(name) = 'id'
         OR (lower(name) LIKE '%!_id' ESCAPE '!' AND lower(type) NOT LIKE '%int%') THEN 'identifier'
       WHEN lower(type) = 'date' THEN 'date' WHEN lower(type) LIKE '%time%' THEN 'timestamp'
       WHEN regexp_matches(lower(name), 'spend|amount|price|revenue|cost|balance') THEN 'financial'
       WHEN lower(type) LIKE '%int%' THEN 'integer' WHEN lower(type) LIKE '%double%' THEN 'float'
       WHEN lower(type) LIKE '%struct%' THEN 'json' ELSE 'text' END AS kind, count(*) AS n
FROM c GROUP BY 1, 2, 3""")
def sch_semantic_kind(t: Tables):
    typed = t.sql(f"""SELECT name, CASE ordinal % 7 WHEN 0 THEN 'uuid' WHEN 1 THEN 'date' WHEN 2 THEN 'TIMESTAMP'
        WHEN 3 THEN 'INTEGER' WHEN 4 THEN 'double' WHEN 5 THEN 'STRUCT(x)' ELSE 'VARCHAR' END AS type
        FROM ({feeds.UPLOAD_COLUMNS}) AS u""")
    kind = coltypes.semantic_kind(F.col("name"), F.col("type")).alias("kind")
    return typed.groupBy("name", "type", kind).agg(F.count(F.lit(1)).alias("n"))


MATCH_CTES = f"""
c AS ({feeds.DATASET_COLUMNS}),
k AS (SELECT *, regexp_replace(regexp_replace(lower(name), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') AS key,
        {CATEGORY_SQL.replace('{t}', 'type')} AS category FROM c),
f AS (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS n_inferred FROM k WHERE layer = 'file'),
x AS (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS n_existing,
        row_number() OVER (PARTITION BY dataset_id, key ORDER BY ordinal) AS rn FROM k WHERE layer = 'silver'),
m AS (SELECT f.tenant_id, f.dataset_id AS file_id, x.dataset_id AS table_id, f.name AS inferred_name,
        x.name AS existing_name, n_inferred, n_existing,
        lower(f.type) = lower(x.type) OR f.category = x.category AS exact_match,
        f.category = 'STRING' OR x.category = 'STRING' AS soft
      FROM f JOIN x ON f.tenant_id = x.tenant_id AND f.key = x.key AND x.rn = 1),
s AS (SELECT tenant_id, file_id, table_id, n_inferred, n_existing, count(*) AS matched,
        count(*) FILTER (exact_match) AS exact_matches, count(*) FILTER (NOT exact_match AND soft) AS compatible_matches
      FROM m GROUP BY ALL),
w AS (SELECT *, CAST(floor((exact_matches + 0.75 * compatible_matches
        + 0.5 * (matched - exact_matches - compatible_matches)) / greatest(n_inferred, n_existing)::DOUBLE * 100 + 0.5)
        AS INT) AS score FROM s),
q AS (SELECT * FROM w WHERE score >= 30 OR matched >= 3)"""


def _files_and_tables(t: Tables):
    columns = feeds.dataset_columns(t)
    return columns.filter("layer = 'file'"), columns.filter("layer <> 'file'")


@query("sch_match_scores", f"""WITH {MATCH_CTES}
SELECT tenant_id, file_id, table_id, score, matched, exact_matches, compatible_matches, n_inferred, n_existing FROM q""")
def sch_match_scores(t: Tables):
    return schema_match.match_scores(*_files_and_tables(t))


@query("sch_match_ranked", f"""WITH {MATCH_CTES},
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, file_id
        ORDER BY score DESC, exact_matches DESC, table_id) AS rank FROM q)
SELECT tenant_id, file_id, table_id, score, matched, exact_matches, compatible_matches, n_inferred, n_existing,
       CAST(rank AS INT) AS rank, CASE WHEN score >= 90 THEN 'exact' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS band,
       rank = 1 AND score >= 70 AS auto_selected, rank = 1 AND score >= 50 AS high_confidence
FROM r""")
def sch_match_ranked(t: Tables):
    return schema_match.ranked_matches(*_files_and_tables(t))


@query("sch_unmatched", f"""WITH {MATCH_CTES}
SELECT q.tenant_id, q.file_id, q.table_id, 'inferred' AS side, f.name FROM q JOIN f ON f.dataset_id = q.file_id
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.file_id = q.file_id AND m.table_id = q.table_id AND m.inferred_name = f.name)
UNION ALL
SELECT q.tenant_id, q.file_id, q.table_id, 'existing', x.name FROM q JOIN x ON x.dataset_id = q.table_id
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.file_id = q.file_id AND m.table_id = q.table_id AND m.existing_name = x.name)""")
def sch_unmatched(t: Tables):
    return schema_match.unmatched_columns(*_files_and_tables(t))


BASE_SQL = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(filename,
  '\.(csv|parquet|json|ndjson|tsv|txt)$', '', 'i'), '[\-_]?(?:20\d{2}[-_]?\d{2}[-_]?\d{2}|\d{10,13})', '', 'g'),
  '[\-_]?(?:v\d+|export|backup|raw|final|sample|data|dataset|dump|output)', '', 'gi')), '[^a-z0-9]+', '_', 'g'), '_')"""

FILENAME_SQL = f"""
b AS (SELECT file_id, {BASE_SQL} AS base FROM u),
fn AS (SELECT file_id, 0 AS pos, base AS name FROM b WHERE length(base) >= 3 AND base <> 'dataset'
       UNION ALL SELECT file_id, 1, base || 's' FROM b
       WHERE length(base) >= 3 AND base <> 'dataset' AND base NOT LIKE '%s' AND base NOT LIKE '%data')"""

IDS_SQL = """
kc AS (SELECT file_id, ordinal, trim(regexp_replace(lower(name), '[^a-z0-9_]', '_', 'g'), '_') AS key FROM c),
ids AS (SELECT file_id, min(ordinal) AS pos, CASE WHEN key = 'customer_id' THEN 'customers' WHEN key = 'log_id' THEN 'logs'
          ELSE regexp_replace(key, '_id$', '') || 's' END AS name FROM kc
        WHERE key LIKE '%!_id' ESCAPE '!' AND (key IN ('customer_id', 'log_id') OR length(key) >= 6) GROUP BY 1, 3)"""


@query("sch_names_filename", f"""WITH u AS ({feeds.UPLOAD_FILES}), {FILENAME_SQL}
SELECT file_id, CAST(pos AS INT) AS priority, name FROM fn""")
def sch_names_filename(t: Tables):
    return name_suggest.suggestions_from_filename(t.sql(feeds.UPLOAD_FILES))


@query("sch_names_ids", f"""WITH c AS ({feeds.UPLOAD_COLUMNS}), {IDS_SQL}
SELECT file_id, pos AS ordinal, name FROM ids""")
def sch_names_ids(t: Tables):
    return name_suggest.suggestions_from_ids(t.sql(feeds.UPLOAD_COLUMNS))


@query("sch_names_final", f"""WITH u AS ({feeds.UPLOAD_FILES}), c AS ({feeds.UPLOAD_COLUMNS}), {FILENAME_SQL}, {IDS_SQL},
h AS (SELECT file_id, bool_or(key LIKE '%exam%' OR key LIKE '%gpa%' OR key LIKE '%grade%' OR key LIKE '%study%'
          OR key LIKE '%education%') AS r1, bool_or(key LIKE '%order%') OR
          (bool_or(key LIKE '%price%') AND bool_or(key LIKE '%quantity%')) AS r2,
        bool_or(regexp_matches(key, 'spend|monthly|subscription|tier')) AS r3,
        bool_or(regexp_matches(key, 'lat|lon|city|country')) AS r4,
        bool_or(regexp_matches(key, 'event|action|payload')) AS r5,
        bool_or(regexp_matches(key, 'salary|department|hire_date')) AS r6 FROM kc GROUP BY 1),
dom AS (SELECT file_id, 0 AS pos, 'student_performance' AS name FROM h WHERE r1
  UNION ALL SELECT file_id, 1, 'academic_records' FROM h WHERE r1 UNION ALL SELECT file_id, 2, 'orders' FROM h WHERE r2
  UNION ALL SELECT file_id, 3, 'sales_transactions' FROM h WHERE r2
  UNION ALL SELECT file_id, 4, 'customer_subscriptions' FROM h WHERE r3
  UNION ALL SELECT file_id, 5, 'locations' FROM h WHERE r4 UNION ALL SELECT file_id, 6, 'activity_events' FROM h WHERE r5
  UNION ALL SELECT file_id, 7, 'employees' FROM h WHERE r6),
rb AS (SELECT file_id, trim(regexp_replace(lower(regexp_replace(filename, '\\.[^.]+$', '')), '[^a-z0-9]+', '_', 'g'), '_')
         AS name FROM u),
a AS (SELECT file_id, 1 AS step, pos, name FROM fn UNION ALL SELECT file_id, 2, pos, name FROM ids
      UNION ALL SELECT file_id, 3, pos, name FROM dom
      UNION ALL SELECT file_id, 4, 0, name FROM rb WHERE length(name) >= 3 AND name <> 'dataset'),
o AS (SELECT file_id, name, min(step * 10000000000::BIGINT + pos) AS place FROM a WHERE length(name) >= 3
        AND name NOT IN ('dataset', 'data', 'file', 'table', 'temp', 'test', 'export') GROUP BY 1, 2),
z AS (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY place, name) AS INT) AS rank, name FROM o)
SELECT file_id, rank, name FROM z WHERE rank <= 5
UNION ALL SELECT file_id, x.rank, x.name FROM u JOIN (VALUES (1, 'ingested_records'), (2, 'source_data'),
  (3, 'imported_table')) AS x(rank, name) ON file_id NOT IN (SELECT file_id FROM o)""")
def sch_names_final(t: Tables):
    return name_suggest.suggest_names(t.sql(feeds.UPLOAD_FILES), t.sql(feeds.UPLOAD_COLUMNS))
