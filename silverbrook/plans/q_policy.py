"""Queries over the statement log, lint and lineage."""

from pyspark.sql import functions as F

from silverbrook.functions import sqltext
from silverbrook.operators import lineage, policy
from silverbrook.plans import feeds
from silverbrook.plans.registry import Tables, query

_WORDS = ", ".join(f"'{w}'" for w in sqltext.FORBIDDEN_WORDS)
_BLANK = r"[\s\pZ]"

AUDIT_CTES = rf"""
q AS (SELECT *, lower(sql) AS low FROM ({feeds.QUERY_LOG}) AS l),
r AS (SELECT *, list_transform(regexp_extract_all(sql, '(?i)(?:from|join){_BLANK}+([a-zA-Z0-9_."]+)', 1),
        lambda x: replace(x, '"', '')) AS tables,
        list_filter([{_WORDS}], lambda w: regexp_matches(sql, '(?i)(^|{_BLANK}|;)' || w || '({_BLANK}|;|$)'))[1] AS word,
        list_filter(['ducklake_catalog', 'payload_core', 'information_schema', 'pg_catalog'],
          lambda s: contains(low, s || '.') OR contains(low, '"' || s || '"'))[1] AS sys,
        len(list_filter(string_split(sql, ';'), lambda p: NOT regexp_full_match(p, '{_BLANK}*'))) AS n_statements
      FROM q),
g AS (SELECT *, list_filter(tables, lambda x: CASE WHEN contains(x, '.')
          THEN split_part(lower(x), '.', 1) NOT IN (tenant_id, tenant_id || '_silver', tenant_id || '_gold')
          ELSE starts_with(lower(x), 'tenant_') AND NOT starts_with(lower(x), tenant_id || '_') END)[1] AS bad FROM r),
v AS (SELECT *, CASE
    WHEN regexp_full_match(sql, '{_BLANK}*') THEN 'empty' WHEN word IS NOT NULL THEN 'write_word'
    WHEN n_statements > 1 THEN 'several_statements' WHEN sys IS NOT NULL THEN 'system_schema'
    WHEN regexp_matches(low, 'read_(parquet|csv|json)\(') AND contains(low, 'tenants/')
      AND NOT contains(low, 'tenants/' || tenant_id || '/') THEN 'foreign_files'
    WHEN contains(bad, '.') THEN 'foreign_schema' WHEN bad IS NOT NULL THEN 'foreign_table' END AS reason FROM g)"""


@query("pol_audit", rf"""WITH {AUDIT_CTES}
SELECT query_id, tenant_id, reason, CASE reason WHEN 'write_word' THEN word WHEN 'system_schema' THEN sys
         WHEN 'foreign_schema' THEN split_part(lower(bad), '.', 1) WHEN 'foreign_table' THEN bad END AS subject, array_to_string(tables, ',') AS table_list,
       CASE WHEN reason IS NULL THEN 'allowed' WHEN reason = 'empty' THEN 'bad_request'
            ELSE 'denied' END AS verdict,
       CASE WHEN reason IS NULL THEN 200 WHEN reason = 'empty' THEN 400 ELSE 403 END AS status
FROM v""")
def pol_audit(t: Tables):
    audited = policy.audit_queries(t.sql(feeds.QUERY_LOG))
    return audited.select("query_id", "tenant_id", "reason", "subject", F.array_join("tables", ",").alias("table_list"),
                          "verdict", "status")


@query("pol_summary", rf"""WITH {AUDIT_CTES}
SELECT tenant_id, CASE WHEN reason IS NULL THEN 'allowed' WHEN reason = 'empty' THEN 'bad_request'
       ELSE 'denied' END AS verdict, count(*) AS n FROM v GROUP BY 1, 2""")
def pol_summary(t: Tables):
    return policy.audit_summary(t.sql(feeds.QUERY_LOG))


@query("pol_refs", rf"""WITH {AUDIT_CTES},
u AS (SELECT tenant_id, unnest(tables) AS table_ref FROM r)
SELECT tenant_id, table_ref, count(*) AS n_refs, count(*) FILTER (CASE WHEN contains(table_ref, '.')
    THEN split_part(lower(table_ref), '.', 1) NOT IN (tenant_id, tenant_id || '_silver', tenant_id || '_gold')
    ELSE starts_with(lower(table_ref), 'tenant_') AND NOT starts_with(lower(table_ref), tenant_id || '_') END) AS n_foreign
FROM u GROUP BY 1, 2""")
def pol_refs(t: Tables):
    return policy.table_usage(t.sql(feeds.QUERY_LOG))


@query("pol_lint", rf"""
WITH q AS ({feeds.QUERY_LOG}),
ch AS (SELECT query_id, generate_subscripts(string_split(sql, ''), 1) AS i, unnest(string_split(sql, '')) AS c FROM q),
qu AS (SELECT *, sum(CASE WHEN c = '''' AND before IS DISTINCT FROM '\' THEN 1 ELSE 0 END)
         OVER (PARTITION BY query_id ORDER BY i) % 2 AS inside
       FROM (SELECT *, lag(c) OVER (PARTITION BY query_id ORDER BY i) AS before FROM ch) AS b),
dp AS (SELECT query_id, i, sum(CASE WHEN inside = 1 THEN 0 WHEN c = '(' THEN 1 WHEN c = ')' THEN -1 ELSE 0 END)
         OVER (PARTITION BY query_id ORDER BY i) AS depth FROM qu),
ps AS (SELECT query_id, min(depth) < 0 AS broken, CAST(arg_max(depth, i) AS BIGINT) AS depth FROM dp GROUP BY 1),
x AS (SELECT q.query_id, q.sql, tenant_id, coalesce(broken, FALSE) AS broken, coalesce(depth, 0) AS depth,
        len(regexp_extract_all(sql, '(^|[^\\])''')) AS n_quotes_min,
        upper(regexp_extract(sql, '(?i),{_BLANK}*(FROM|WHERE|GROUP{_BLANK}+BY|ORDER{_BLANK}+BY|LIMIT|HAVING)\b', 1)) AS comma,
        upper(regexp_extract(sql, '(?i)\b(DROP|ALTER|TRUNCATE|DELETE{_BLANK}+FROM|INSERT{_BLANK}+INTO|UPDATE|ATTACH|COPY)\b', 1))
          AS ddl,
        regexp_extract(sql, '(?i)\btenant_([a-zA-Z0-9]+)_[a-zA-Z0-9_]+', 0) AS tref,
        regexp_extract(sql, '(?i)\btenant_([a-zA-Z0-9]+)_[a-zA-Z0-9_]+', 1) AS towner
      FROM q LEFT JOIN ps ON ps.query_id = q.query_id),
nq AS (SELECT query_id, count(*) FILTER (c = '''' AND before IS DISTINCT FROM '\') AS n_quotes FROM qu GROUP BY 1)
SELECT x.query_id, CASE WHEN regexp_full_match(sql, '{_BLANK}*') THEN '' ELSE array_to_string(list_filter([
  CASE WHEN n_quotes % 2 = 1 THEN 'unclosed_quote' END, CASE WHEN broken THEN 'unexpected_close' END,
  CASE WHEN NOT broken AND depth > 0 THEN 'unclosed_paren:' || CAST(depth AS STRING) END,
  CASE WHEN comma <> '' THEN 'trailing_comma:' || comma END,
  CASE WHEN regexp_matches(sql, '(?i)SELECT{_BLANK}+FROM\b') THEN 'empty_select' END,
  CASE WHEN ddl <> '' THEN 'prohibited:' || ddl END,
  CASE WHEN tref <> '' AND 'tenant_' || towner <> tenant_id THEN 'foreign_table:' || tref END],
  lambda f: f IS NOT NULL), '|') END AS findings
FROM x LEFT JOIN nq ON nq.query_id = x.query_id""")
def pol_lint(t: Tables):
    linted = policy.lint_queries(t.sql(feeds.QUERY_LOG))
    return linted.select("query_id", F.array_join("findings", "|").alias("findings"))


EDGE_CTES = rf"""
o AS ({feeds.GOLD_OBJECTS}),
d AS (SELECT tenant_id, name, object_type, unnest(regexp_extract_all(sql_query,
        '(?i)\b(?:from|join){_BLANK}+([a-zA-Z0-9_.]+)', 1)) AS ref FROM o),
e AS (SELECT DISTINCT tenant_id, name, object_type, replace(replace(replace(ref, tenant_id || '_silver.', ''),
        tenant_id || '_gold.', ''), tenant_id || '_', '') AS dependency FROM d)"""


@query("lin_edges", rf"""WITH {EDGE_CTES}
SELECT tenant_id, name, dependency FROM e WHERE dependency <> '' AND dependency <> name""")
def lin_edges(t: Tables):
    return lineage.dependency_edges(t.sql(feeds.GOLD_OBJECTS))


def _with_dependencies(t: Tables):
    objects = t.sql(feeds.GOLD_OBJECTS)
    return objects.withColumn(
        "dependencies", sqltext.dependencies(F.col("sql_query"), F.col("tenant_id"), F.col("name")))


@query("lin_dependents", rf"""WITH {EDGE_CTES}
SELECT tenant_id, dependency AS name, name AS dependent, object_type FROM e
WHERE dependency LIKE 'src!_%' ESCAPE '!' AND dependency <> name""")
def lin_dependents(t: Tables):
    objects = _with_dependencies(t)
    sources = t.orders.select(F.concat(F.lit("tenant_"), "o_custkey").alias("tenant_id"),
                              F.concat(F.lit("src_"), F.lower("o_orderstatus")).alias("name"))
    return lineage.dependents(objects, sources)


@query("lin_dependents_text", rf"""
SELECT name, object_type FROM ({feeds.GOLD_OBJECTS}) AS o WHERE tenant_id = 'tenant_7' AND contains(lower(sql_query), 'src_f')""")
def lin_dependents_text(t: Tables):
    """Dependents of one object, counting any definition that contains its name."""
    return lineage.dependents_of(_with_dependencies(t), "tenant_7", "src_f", substring=True).select(
        "name", "object_type")


@query("lin_missing", rf"""WITH {EDGE_CTES},
t AS (SELECT tenant_id, 'dim_' || substr(n, 1, 1) AS name FROM
        (SELECT 'tenant_' || CAST(o_custkey AS STRING) AS tenant_id, o_orderpriority AS n FROM {{orders}}) AS x
      UNION ALL SELECT 'tenant_' || CAST(o_custkey AS STRING), 'src_' || lower(o_orderstatus) FROM {{orders}})
SELECT tenant_id, name, count(*) AS n_missing FROM e
WHERE dependency <> '' AND dependency <> name AND NOT EXISTS (SELECT 1 FROM t WHERE t.tenant_id = e.tenant_id
  AND t.name = lower(replace(dependency, replace(e.tenant_id, 't', 'T') || '_gold.', ''))) GROUP BY 1, 2""")
def lin_missing(t: Tables):
    edges = lineage.dependency_edges(t.sql(feeds.GOLD_OBJECTS))
    tenant = F.concat(F.lit("tenant_"), "o_custkey").alias("tenant_id")
    names = t.orders.select(tenant, F.concat(F.lit("dim_"), F.substring("o_orderpriority", 1, 1)).alias("name")).unionAll(
        t.orders.select(tenant, F.concat(F.lit("SRC_"), "o_orderstatus")))
    return lineage.missing_sources(edges, names.withColumn("full_name", F.concat_ws("_silver.", "tenant_id", "name")))
