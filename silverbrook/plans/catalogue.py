"""All registered queries with their oracles."""

from silverbrook.plans import q_catalog, q_policy, q_schema, q_sinks, q_sources, q_sql, q_stream  # noqa: F401
from silverbrook.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
