"""Queries of the SQL surface, written with the DataFrame API.

Money is summed as decimals, so totals do not depend on the order of addition; results
are handed out as doubles.
"""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from silverbrook.operators.ordered import asof_join, previous_value, quantiles, range_join, running_total
from silverbrook.plans.registry import Tables, query
from silverbrook.plans.tenant_query import QueryResult, TenantGuard, capped, tenant_sql


def money(name: str):
    return F.col(name).cast("decimal(18,2)")


def total(name: str):
    return F.sum(money(name)).cast("double")


def mean(name: str):
    return F.sum(money(name)).cast("double") / F.count(name)


def flagship(t: Tables):
    """Customers, mean and total balance per nation: the studio's revenue report."""
    accounts = t.customer.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("customers"), mean("c_acctbal").alias("avg_balance"),
        total("c_acctbal").alias("total_balance"))
    named = accounts.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("n_name", "customers", "avg_balance", "total_balance").orderBy(
        F.desc("total_balance"), "n_name").limit(50)


query("sql_groupby", """
SELECT n_name, count(*) AS customers,
       CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(c_acctbal) AS avg_balance,
       CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total_balance
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY total_balance DESC, n_name LIMIT 50""")(flagship)


@query("sql_run", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS discounted
FROM {lineitem} GROUP BY 1, 2""")
def sql_run(t: Tables):
    """Guarded tenant SQL over a table published from plain Parquet files."""
    # The alias is registered on existing files: nothing is copied. Its name is new to the session.
    tenant = f"tenant_{uuid.uuid4().hex[:10]}"
    t.lineitem.createTempView(f"{tenant}_lines")
    return tenant_sql(t.spark, TenantGuard(t.spark, [tenant]), tenant, f"""
        SELECT l_returnflag, l_linestatus, count(*) AS n,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE)
                 AS discounted
        FROM {tenant}_lines GROUP BY ALL;""").full


@query("sql_capped", """
SELECT o_orderkey, o_totalprice, (SELECT count(*) > 1000 FROM {orders}) AS truncated FROM {orders}
ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000""")
def sql_capped(t: Tables):
    """The result cap is the feature: 1000 rows and a flag that more exist."""
    return capped(t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey"))


@query("sql_page", """
SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def sql_page(t: Tables):
    ordered = t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return QueryResult(ordered).page(3)


@query("sql_distinct", "SELECT DISTINCT l_shipdate AS shipped, l_returnflag AS flag FROM {lineitem}")
def sql_distinct(t: Tables):
    return t.lineitem.select(F.col("l_shipdate").alias("shipped"), F.col("l_returnflag").alias("flag")).distinct()


@query("sql_predicates", """
SELECT o_orderkey, o_orderpriority FROM {orders} WHERE (o_orderpriority LIKE '%HIGH' OR o_orderpriority ILIKE '%low%')
  AND o_totalprice BETWEEN 100000 AND 300000 AND o_orderstatus IN ('F', 'P') AND o_custkey IS NOT NULL
  AND NOT o_orderdate < TIMESTAMP '1996-01-01'""")
def sql_predicates(t: Tables):
    p = F.col("o_orderpriority")
    return t.orders.filter(
        (p.like("%HIGH") | p.ilike("%low%")) & F.col("o_totalprice").between(100000, 300000)
        & F.col("o_orderstatus").isin("F", "P") & F.col("o_custkey").isNotNull()
        & ~(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    ).select("o_orderkey", "o_orderpriority")


@query("sql_having", """
SELECT l_partkey, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM {lineitem}
GROUP BY l_partkey HAVING count(*) > 30 AND max(l_discount) >= 0.1""")
def sql_having(t: Tables):
    grouped = t.lineitem.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), total("l_quantity").alias("quantity"), F.max("l_discount").alias("top"))
    return grouped.filter((F.col("n") > 30) & (F.col("top") >= 0.1)).drop("top")


@query("sql_topk", """
SELECT event_id, user_id, value FROM {events} ORDER BY value DESC NULLS LAST, event_id LIMIT 100""")
def sql_topk(t: Tables):
    return t.events.select("event_id", "user_id", "value").orderBy(
        F.col("value").desc_nulls_last(), "event_id").limit(100)


@query("sql_join_inner", """
SELECT n_name, o_orderpriority, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def sql_join_inner(t: Tables):
    """Orders collapse per customer before any join, so the joins see one row per key."""
    per_customer = t.orders.groupBy("o_custkey", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).alias("s"))
    placed = per_customer.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    named = placed.groupBy("c_nationkey", "o_orderpriority").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name", "o_orderpriority").agg(
        F.sum("n").alias("orders"), F.sum("s").cast("double").alias("spent"))


@query("sql_join_left", """
SELECT o_orderkey, count(l_orderkey) AS lines FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey
GROUP BY o_orderkey""")
def sql_join_left(t: Tables):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", F.coalesce("n", F.lit(0)).alias("lines"))


@query("sql_join_right", """
SELECT c_custkey, c_mktsegment, u.n AS events FROM (SELECT user_id, count(*) AS n FROM {events} GROUP BY 1) AS u
RIGHT JOIN {customer} ON u.user_id = c_custkey""")
def sql_join_right(t: Tables):
    seen = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    return seen.join(t.customer, F.col("user_id") == F.col("c_custkey"), "right").select(
        "c_custkey", "c_mktsegment", "events")


@query("sql_join_full", """
SELECT coalesce(doc_key, quality_key) AS doc_id, lang, quality FROM
  (SELECT doc_id * 2 AS doc_key, lang FROM {documents}) AS d
FULL JOIN (SELECT doc_id AS quality_key, quality FROM {labels}) AS l ON doc_key = quality_key""")
def sql_join_full(t: Tables):
    """Keys of one side are doubled, so that both sides have rows without a partner."""
    docs = t.documents.select((F.col("doc_id") * 2).alias("doc_id"), "lang")
    return docs.join(t.labels.select("doc_id", "quality"), "doc_id", "full")


@query("sql_join_cross", """
SELECT p.o_orderpriority, s.o_orderstatus, count(o.o_orderkey) AS n
FROM (SELECT DISTINCT o_orderpriority FROM {orders}) AS p CROSS JOIN (SELECT DISTINCT o_orderstatus FROM {orders}) AS s
LEFT JOIN {orders} AS o ON o.o_orderpriority = p.o_orderpriority AND o.o_orderstatus = s.o_orderstatus
GROUP BY 1, 2""")
def sql_join_cross(t: Tables):
    """Every priority with every status, zero counts included; the cross product is of two short lists."""
    grid = t.orders.select("o_orderpriority").distinct().crossJoin(t.orders.select("o_orderstatus").distinct())
    counts = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["o_orderpriority", "o_orderstatus"], "left").select(
        "o_orderpriority", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n"))


@query("sql_union", """
SELECT 'distinct' AS kind, k FROM (SELECT o_custkey AS k FROM {orders} UNION SELECT c_custkey FROM {customer}) AS d
UNION ALL SELECT 'all', k FROM (SELECT s_suppkey AS k FROM {supplier} UNION ALL SELECT p_partkey FROM {part}) AS a""")
def sql_union(t: Tables):
    distinct = t.orders.select(F.col("o_custkey").alias("k")).union(t.customer.select("c_custkey")).distinct()
    both = t.supplier.select(F.col("s_suppkey").alias("k")).union(t.part.select("p_partkey"))
    return distinct.select(F.lit("distinct").alias("kind"), "k").union(both.select(F.lit("all"), "k"))


@query("sql_case", """
SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size_band,
       count(*) AS n, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned FROM {lineitem} GROUP BY 1""")
def sql_case(t: Tables):
    band = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "medium").otherwise("large")
    return t.lineitem.groupBy(band.alias("size_band")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


CTE_SQL = """
WITH spent AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s, count(*) AS n FROM {orders} GROUP BY 1),
     heavy AS (SELECT * FROM spent WHERE n >= 12)
SELECT c_mktsegment, count(*) AS customers, CAST(max(heavy.s) AS DOUBLE) AS top FROM heavy
JOIN {customer} ON c_custkey = o_custkey GROUP BY c_mktsegment"""


@query("sql_cte", CTE_SQL)
def sql_cte(t: Tables):
    return t.sql(CTE_SQL)


@query("sql_strings", """
SELECT c_custkey, concat(c_mktsegment, CASE WHEN c_nationkey > 12 THEN NULL ELSE '-x' END) AS joined,
       lower(c_mktsegment) AS lo, upper(substring(c_name, 1, 4)) AS up, trim('  ' || c_mktsegment || ' ') AS trimmed,
       length(c_name) AS len FROM {customer}""")
def sql_strings(t: Tables):
    tag = F.when(F.col("c_nationkey") > 12, F.lit(None)).otherwise("-x")
    return t.customer.select(
        "c_custkey", F.concat_ws("", "c_mktsegment", tag).alias("joined"), F.lower("c_mktsegment").alias("lo"),
        F.upper(F.substring("c_name", 1, 4)).alias("up"),
        F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("trimmed"),
        F.length("c_name").cast("bigint").alias("len"))


@query("sql_date_trunc", """
SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n FROM {orders} GROUP BY 1""")
def sql_date_trunc(t: Tables):
    return t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))


@query("sql_casts", """
SELECT event_id, TRY_CAST(event_type AS BIGINT) AS as_number, TRY_CAST(CAST(user_id AS STRING) AS BIGINT) AS back,
       coalesce(CASE WHEN value > 5 THEN event_type END, 'none') AS label, CAST(ts AS DATE) AS day FROM {events}""")
def sql_casts(t: Tables):
    return t.events.select(
        "event_id", F.col("event_type").try_cast("bigint").alias("as_number"),
        F.col("user_id").cast("string").try_cast("bigint").alias("back"),
        F.coalesce(F.when(F.col("value") > 5, F.col("event_type")), F.lit("none")).alias("label"),
        F.col("ts").cast("date").alias("day"))


@query("sql_semi", """
SELECT o_orderkey, o_custkey FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey
  AND l_returnflag = 'R')""")
def sql_semi(t: Tables):
    returned = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(returned, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("sql_anti", """
SELECT o_orderkey, o_custkey FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey)""")
def sql_anti(t: Tables):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("sql_range_join", """
SELECT e.event_id AS error_id, c.event_id AS click_id, c.user_id FROM {events} AS c JOIN {events} AS e
  ON c.user_id = e.user_id AND c.ts >= e.ts AND c.ts < e.ts + INTERVAL 6 HOUR
WHERE c.event_type = 'click' AND e.event_type = 'error'""")
def sql_range_join(t: Tables):
    """Clicks within six hours after an error of the same user."""
    clicks = t.events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    errors = t.events.filter("event_type = 'error'").select(
        "user_id", F.col("ts").alias("starts"), F.expr("ts + INTERVAL 6 HOUR").alias("ends"),
        F.col("event_id").alias("error_id"))
    return range_join(clicks, errors, ["user_id"], "ts", "starts", "ends").select(
        "error_id", "click_id", "user_id")


@query("sql_asof", """
SELECT p.event_id, p.user_id, p.ts, c.ts AS asof_ts, c.event_id AS asof_click_id
FROM (SELECT * FROM {events} WHERE event_type = 'purchase') AS p
ASOF LEFT JOIN (SELECT * FROM {events} WHERE event_type = 'click') AS c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def sql_asof(t: Tables):
    """Each purchase with the last click before it."""
    purchases = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = t.events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return asof_join(purchases, clicks, ["user_id"], "ts", ["click_id"], lambda ts: F.date_trunc("day", ts))


@query("sql_setops", """
SELECT 'both' AS kind, k FROM (SELECT l_partkey AS k FROM {lineitem} WHERE l_returnflag = 'A' INTERSECT
  SELECT l_partkey FROM {lineitem} WHERE l_returnflag = 'R') AS i
UNION ALL SELECT 'only', k FROM (SELECT p_partkey AS k FROM {part} EXCEPT
  SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45) AS x""")
def sql_setops(t: Tables):
    flag = lambda f: t.lineitem.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    both = flag("A").intersect(flag("R"))
    only = t.part.select(F.col("p_partkey").alias("k")).subtract(t.lineitem.filter("l_quantity > 45").select("l_partkey"))
    return both.select(F.lit("both").alias("kind"), "k").union(only.select(F.lit("only"), "k"))


@query("sql_rollup", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def sql_rollup(t: Tables):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), total("l_quantity").alias("quantity"))


@query("sql_cube", """
SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS g, count(*) AS n
FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def sql_cube(t: Tables):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))


@query("sql_grouping_sets", """
SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM {documents}
GROUP BY GROUPING SETS ((lang, source), (lang), (source))""")
def sql_grouping_sets(t: Tables):
    by = [F.col("lang"), F.col("source")]
    return t.documents.groupingSets([by, by[:1], by[1:]], *by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("sql_count_distinct", """
SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n
FROM {lineitem} GROUP BY 1""")
def sql_count_distinct(t: Tables):
    """Two stages per column by hand: dedupe on (flag, key) first, so few groups still spread out."""
    def per_flag(column: str, name: str):
        pairs = t.lineitem.groupBy("l_returnflag", column).agg(F.count(F.lit(1)).alias("c"))
        return pairs.groupBy("l_returnflag").agg(F.count(column).alias(name), F.sum("c").alias("n"))

    parts = per_flag("l_partkey", "parts")
    suppliers = per_flag("l_suppkey", "suppliers").select(F.col("l_returnflag").alias("flag"), "suppliers")
    return parts.join(suppliers, F.col("l_returnflag").eqNullSafe(F.col("flag"))).drop("flag")


@query("sql_rank", """
SELECT o_custkey, o_orderkey, o_totalprice, CAST(rn AS INT) AS place FROM (SELECT *, row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) AS r WHERE rn <= 3""")
def sql_rank(t: Tables):
    """Top three per customer; Spark cuts every group before the shuffle as well as after."""
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(best).alias("place"))
    return ranked.filter("place <= 3")


@query("sql_lag", """
SELECT event_id, user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous
FROM {events}""")
def sql_lag(t: Tables):
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    return previous_value(rows, ["user_id"], ["ts", "event_id"], "event_type", F.date_trunc("day", "ts"), "previous")


@query("sql_running", """
SELECT event_id, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY event_type ORDER BY ts, event_id
  ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM {events}""")
def sql_running(t: Tables):
    """Running total per event type: five keys, yet parallel over their hours."""
    rows = running_total(t.events.select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"],
                         money("value"), F.date_trunc("hour", "ts"), "running")
    return rows.select("event_id", "event_type", F.col("running").cast("double").alias("running"))


@query("sql_quantile", """
SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.9) AS p90
FROM {lineitem} GROUP BY 1""")
def sql_quantile(t: Tables):
    """Exact quantiles from value counts: the state is one entry per distinct quantity."""
    counted = t.lineitem.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("l_returnflag").agg(
        F.percentile("l_quantity", F.lit(0.5), F.col("n")).alias("median"),
        F.percentile("l_quantity", F.lit(0.9), F.col("n")).alias("p90"))


@query("sql_quantile_price", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM {lineitem} GROUP BY 1""")
def sql_quantile_price(t: Tables):
    """Exact quantiles of a column of mostly distinct values, by rank over sorted pieces."""
    found = quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p25": 0.25, "median": 0.5, "p99": 0.99})
    return found.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p25", "median", "p99")])


@query("sql_range_lengths", """
WITH r AS (SELECT event_id AS rid, user_id, ts AS starts,
             ts + CASE event_id % 4 WHEN 0 THEN INTERVAL 1 SECOND WHEN 1 THEN INTERVAL 1 HOUR
                  WHEN 2 THEN INTERVAL 9 DAY ELSE INTERVAL 400 DAY END AS ends
           FROM {events} WHERE event_type = 'error')
SELECT rid, count(*) AS n FROM r JOIN {events} e ON e.user_id = r.user_id AND e.ts >= r.starts AND e.ts < r.ends GROUP BY rid""")
def sql_range_lengths(t: Tables):
    """Events within ranges that last from a second to more than a year."""
    length = F.when(F.col("event_id") % 4 == 0, F.expr("INTERVAL '1' SECOND")).when(
        F.col("event_id") % 4 == 1, F.expr("INTERVAL '3600' SECOND")).when(
        F.col("event_id") % 4 == 2, F.expr("INTERVAL '777600' SECOND")).otherwise(F.expr("INTERVAL '34560000' SECOND"))
    errors = t.events.filter("event_type = 'error'").select(
        F.col("event_id").alias("rid"), "user_id", F.col("ts").alias("starts"), (F.col("ts") + length).alias("ends"))
    return range_join(t.events.select("user_id", "ts"), errors, ["user_id"], "ts", "starts", "ends").groupBy("rid").agg(
        F.count("*").alias("n"))


@query("sql_approx")
def sql_approx(t: Tables):
    """Sketch-based distinct counts and quantiles; estimates, so there is no exact counterpart."""
    return t.lineitem.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_orderkey").alias("orders"),
        F.percentile_approx("l_extendedprice", [0.25, 0.5, 0.75]).alias("quartiles"))


@query("sql_json", """
SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, count(*) AS n FROM {events} GROUP BY 1, 2""")
def sql_json(t: Tables):
    k = F.from_json("props", "k bigint")["k"]
    return t.events.groupBy(k.alias("k"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("sql_arrays", """
SELECT vec_id, len(embedding) AS dims, list_max(embedding) AS hi, list_min(embedding) AS lo,
       len(list_filter(embedding, lambda x: x > 0)) AS positive, embedding[1] AS first_value FROM {embeddings}""")
def sql_arrays(t: Tables):
    e = F.col("embedding")
    return t.embeddings.select(
        "vec_id", F.size(e).cast("bigint").alias("dims"), F.array_max(e).alias("hi"), F.array_min(e).alias("lo"),
        F.size(F.filter(e, lambda x: x > 0)).cast("bigint").alias("positive"), F.get(e, F.lit(0)).alias("first_value"))


@query("sql_unnest", """
SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM {documents}) AS w
GROUP BY word""")
def sql_unnest(t: Tables):
    words = t.documents.select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("sql_math", """
SELECT c_custkey, abs(c_acctbal) AS magnitude, CAST(floor(c_acctbal) AS BIGINT) AS lower_bound,
       CAST(ceil(c_acctbal) AS BIGINT) AS upper_bound, sqrt(abs(c_acctbal)) AS root,
       CAST(c_custkey % 7 AS BIGINT) AS remainder, CAST(sign(c_acctbal) AS INT) AS direction,
       CASE WHEN c_nationkey = 0 THEN NULL ELSE c_acctbal / c_nationkey END AS ratio FROM {customer}""")
def sql_math(t: Tables):
    b = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey", F.abs(b).alias("magnitude"), F.floor(b).alias("lower_bound"), F.ceil(b).alias("upper_bound"),
        F.sqrt(F.abs(b)).alias("root"), (F.col("c_custkey") % 7).alias("remainder"),
        F.signum(b).cast("int").alias("direction"), F.try_divide(b, F.col("c_nationkey")).alias("ratio"))


@query("sql_dates", """
SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS age_days,
       CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(quarter FROM o_orderdate) AS INT) AS q,
       CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS due, CAST(isodow(o_orderdate) AS INT) AS weekday FROM {orders}""")
def sql_dates(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.date_diff(d.cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("age_days"),
        F.year(d).alias("y"), F.quarter(d).alias("q"), F.add_months(d.cast("date"), 1).alias("due"),
        (F.weekday(d.cast("date")) + 1).alias("weekday"))


CORRELATED_SQL = """
SELECT o_orderkey, o_custkey FROM {orders} AS o
WHERE CAST(o_totalprice AS DECIMAL(18,2)) > (SELECT max(CAST(i.o_totalprice AS DECIMAL(18,2))) * 0.9 FROM {orders} AS i
  WHERE i.o_custkey = o.o_custkey)"""


@query("sql_correlated", CORRELATED_SQL)
def sql_correlated(t: Tables):
    return t.sql(CORRELATED_SQL)


