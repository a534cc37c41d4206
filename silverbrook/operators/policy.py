"""Audit of SQL logs against the tenant guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverbrook.functions import sqltext
from silverbrook.session import each, spread

# Reasons for a refusal, in the order the rules are tried. ``subject`` names what the rule found.
EMPTY, WRITE_WORD, SEVERAL, SYSTEM_SCHEMA, FOREIGN_FILES, FOREIGN_SCHEMA, FOREIGN_TABLE = REASONS = (
    "empty", "write_word", "several_statements", "system_schema", "foreign_files", "foreign_schema", "foreign_table")


def audit_queries(log: DataFrame, tenant: str = "tenant_id", sql: str = "sql") -> DataFrame:
    """Add ``tables``, ``reason``, ``subject``, ``verdict`` and ``status`` to every logged statement.

    A narrow job: one scan of the log, no shuffle. References are extracted once, in
    their own projection, because two rules and the output need them.
    """
    t, s = F.col(tenant), F.coalesce(F.col(sql), F.lit(""))
    word, schema, foreign = F.col("_word"), F.col("_schema"), F.col("_foreign")
    reason = (
        F.when(sqltext.is_empty(s), EMPTY)
        .when(word.isNotNull(), WRITE_WORD)
        .when(sqltext.statement_count(s) > 1, SEVERAL)
        .when(schema.isNotNull(), SYSTEM_SCHEMA)
        .when(sqltext.reads_foreign_files(s, t), FOREIGN_FILES)
        .when(foreign.contains("."), FOREIGN_SCHEMA)
        .when(foreign.isNotNull(), FOREIGN_TABLE)
    )
    found = F.col("reason")
    subject = (
        F.when(found == WRITE_WORD, word).when(found == SYSTEM_SCHEMA, schema)
        .when(found == FOREIGN_SCHEMA, F.substring_index(F.lower(foreign), ".", 1)).when(found == FOREIGN_TABLE, foreign)
    )
    refused, forbidden = found.isNotNull(), found != EMPTY
    staged = spread(log).select(
        "*", sqltext.referenced_tables(s).alias("tables"),
        sqltext.forbidden_word(s).alias("_word"), sqltext.system_schema(s).alias("_schema"))
    first_foreign = F.get(F.filter("tables", lambda r: sqltext.is_foreign_reference(r, t)), F.lit(0))
    return (
        staged.withColumn("_foreign", first_foreign)
        .withColumn("reason", reason)
        .withColumn("subject", subject)
        .withColumn("verdict", F.when(~refused, "allowed").when(forbidden, "denied").otherwise("bad_request"))
        .withColumn("status", F.when(~refused, 200).when(forbidden, 403).otherwise(400))
        .drop("_word", "_schema", "_foreign")
    )


def audit_summary(log: DataFrame, tenant: str = "tenant_id", sql: str = "sql") -> DataFrame:
    """Statements per tenant and verdict."""
    return audit_queries(log, tenant, sql).groupBy(tenant, "verdict").agg(F.count(F.lit(1)).alias("n"))


def table_usage(log: DataFrame, tenant: str = "tenant_id", sql: str = "sql") -> DataFrame:
    """How often each table is referenced, with the share that is refused as foreign."""
    found = sqltext.referenced_tables(F.coalesce(F.col(sql), F.lit("")))
    refs = each(spread(log), found, "table_ref", F.col(tenant).alias("tenant_id"))
    foreign = sqltext.is_foreign_reference(F.col("table_ref"), F.col("tenant_id"))
    return refs.groupBy("tenant_id", "table_ref").agg(
        F.count(F.lit(1)).alias("n_refs"), F.count_if(foreign).alias("n_foreign"))


def lint_queries(log: DataFrame, tenant: str = "tenant_id", sql: str = "sql") -> DataFrame:
    """Add an array of advisory ``findings`` to every logged statement."""
    return spread(log).withColumn("findings", sqltext.lint(F.col(sql), F.col(tenant)))
