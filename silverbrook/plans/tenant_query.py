"""Guarded execution of one tenant's SQL.

The statement is parsed by Spark and the guard looks at that parse, so comments, quoting,
comma joins and nested queries cannot hide a table. Every plan node must be of a kind that
only reads (an allow-list), every relation must belong to the tenant, and the relations
are judged once more on the analysed plan, below views. Nothing runs before both checks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverbrook.functions.sqltext import SYSTEM_SCHEMAS

# Row cap of a query result and rows per result page.
MAX_ROWS = 1000
PAGE_SIZE = 25

# File formats Spark accepts as the first part of a path table.
_PATH_FORMATS = {"parquet", "csv", "json", "orc", "text", "binaryfile", "avro", "xml", "delta"}

# Functions that call arbitrary Java code.
_UNSAFE_FUNCTIONS = {"reflect", "java_method", "try_reflect"}

# Plan nodes a statement may consist of; all of them only read what lies below.
_READING_NODES = {
    "Aggregate", "AsOfJoin", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit",
    "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "OneRowRelation$",
    "Pivot", "Project", "RepartitionByExpression", "Sample", "Sort", "SubqueryAlias", "Tail", "Union", "UnionLoop",
    "UnionLoopRef", "Unpivot", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedOrderBy",
    "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableAliases", "UnresolvedTableValuedFunction",
    "UnresolvedWith", "Window", "WithWindowDefinition",
}

# Table functions without access to anything but their arguments.
_TABLE_FUNCTIONS = {
    "range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple",
    "variant_explode", "variant_explode_outer",
}


class QueryRefused(Exception):
    """The statement may not run; ``status`` is 403 for isolation rules, else 400."""

    def __init__(self, message: str, status: int = 403):
        super().__init__(message)
        self.status = status


class TenantGuard:
    """Decides which relations a tenant may read.

    ``tenants`` is the registry of tenant ids. A flat name belongs to the tenant with the
    longest matching prefix, so ``tenant_a`` does not own ``tenant_a_b_events`` when
    ``tenant_a_b`` exists. ``file_root`` allows path tables below the tenant's prefix.
    """

    def __init__(self, spark: SparkSession, tenants: Iterable[str], file_root: str | None = None):
        self.spark = spark
        self.tenants = {t.lower() for t in tenants}
        self.file_root = file_root.rstrip("/") if file_root else None
        find = spark._jvm.java.lang.Class.forName
        self._tree = find("org.apache.spark.sql.catalyst.trees.TreeNode")
        self._iterable = find("scala.collection.Iterable")
        self._product = find("scala.Product")
        self._plan = find("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")

    # parse inspection --------------------------------------------------------------
    def _parse(self, sql: str):
        try:
            return self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except Exception as error:
            raise QueryRefused(f"statement does not parse: {str(error).splitlines()[0]}", 400) from None

    def _children(self, node) -> Iterator:
        """Tree nodes directly below a parsed node, whatever container holds them."""
        pending = [node.productIterator()]
        while pending:
            items = pending.pop()
            while items.hasNext():
                item = items.next()
                if not hasattr(item, "getClass"):
                    continue
                if self._tree.isInstance(item):
                    yield item
                elif self._iterable.isInstance(item):
                    pending.append(item.iterator())
                elif self._product.isInstance(item):
                    pending.append(item.productIterator())

    @staticmethod
    def _strings(seq) -> list[str]:
        items = seq.iterator()
        out = []
        while items.hasNext():
            out.append(items.next())
        return out

    def relations(self, sql: str) -> list[list[str]]:
        """Name parts of every table the statement reads, WITH names left out."""
        found: list[list[str]] = []
        self._walk(self._parse(sql), frozenset(), found)
        return found

    def _walk(self, node, ctes: frozenset[str], found: list[list[str]]) -> None:
        kind = node.getClass().getSimpleName()
        if self._plan.isInstance(node) and kind not in _READING_NODES:
            raise QueryRefused(f"Only queries are allowed; {kind} is prohibited.")
        if kind == "UnresolvedTableValuedFunction":
            name = ".".join(self._strings(node.name())).lower()
            if name not in _TABLE_FUNCTIONS:
                raise QueryRefused(f"Table function '{name}' is prohibited.")
        if kind == "UnresolvedFunction":
            name = self._strings(node.nameParts())[-1].lower()
            if name in _UNSAFE_FUNCTIONS:
                raise QueryRefused(f"Function '{name}' is prohibited.")
        if kind in ("UnresolvedIdentifier", "PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier"):
            raise QueryRefused("Computed table names are prohibited.")
        if kind == "UnresolvedRelation":
            parts = self._strings(node.multipartIdentifier())
            if not (len(parts) == 1 and parts[0].lower() in ctes):
                found.append(parts)
            return
        if kind == "UnresolvedWith":
            # A WITH name is visible in later definitions and in the body, not outside.
            definitions = node.cteRelations().iterator()
            while definitions.hasNext():
                entry = definitions.next().productIterator()
                name, body = entry.next().lower(), entry.next()
                scope = ctes | {name} if node.allowRecursion() else ctes
                self._walk(body, scope, found)
                ctes = ctes | {name}
            self._walk(node.child(), ctes, found)
            return
        for child in self._children(node):
            self._walk(child, ctes, found)

    # rules -------------------------------------------------------------------------
    def owner(self, flat_name: str) -> str | None:
        """The registered tenant with the longest id that prefixes the name."""
        parts = flat_name.lower().split("_")
        heads = ("_".join(parts[:n]) for n in range(len(parts) - 1, 0, -1))
        return next((h for h in heads if h in self.tenants), None)

    # The wording of refusals below is part of the interface that clients match on.
    def _check_relation(self, tenant: str, parts: list[str]) -> None:
        first, shown = parts[0].lower(), ".".join(parts)
        if len(parts) == 1:
            if self.owner(first) != tenant:
                raise QueryRefused(f"Access Denied: Cross-tenant table access prohibited: '{shown}'.")
        elif first in SYSTEM_SCHEMAS:
            raise QueryRefused(f"Access Denied: Cross-schema query to '{first}' is prohibited.")
        elif first in _PATH_FORMATS:
            own = f"{self.file_root}/tenants/{tenant}/" if self.file_root else None
            path = parts[-1]
            if own is None or not path.startswith(own) or ".." in path or re.search(r"[{},*?\[\]]", path):
                raise QueryRefused(f"Access Denied: file access outside tenant '{tenant}' scope.")
        elif len(parts) > 2 or first not in (tenant, f"{tenant}_silver", f"{tenant}_gold"):
            raise QueryRefused(f"Access Denied: Cross-tenant schema access prohibited: '{shown}'.")

    def check_analysed(self, tenant: str, df: DataFrame) -> DataFrame:
        """``df`` if everything its analysed plan reads belongs to the tenant, below views too."""
        self._walk_analysed(tenant.lower(), df._jdf.queryExecution().analyzed(), False)
        return df

    def _walk_analysed(self, tenant: str, node, approved: bool) -> None:
        """``approved`` holds below a session view, whose name the first check has judged."""
        kind = node.getClass().getSimpleName()
        if kind == "View":
            name = node.desc().identifier()
            if node.isTempView():
                approved = True
            self._check_stored(tenant, name)
        elif kind == "LogicalRelation":
            stored = node.catalogTable()
            if stored.isDefined():
                self._check_stored(tenant, stored.get().identifier())
            elif not approved:
                self._check_files(tenant, node.relation())
            return
        elif kind in ("HiveTableRelation", "UnresolvedCatalogRelation"):
            self._check_stored(tenant, node.tableMeta().identifier())
        elif kind in ("DataSourceV2Relation", "DataSourceV2ScanRelation", "VariableReference") and not approved:
            raise QueryRefused(f"Access Denied: {kind} is prohibited.")
        for child in self._children(node):
            self._walk_analysed(tenant, child, approved)

    def _check_stored(self, tenant: str, name) -> None:
        schema = name.database().get().lower() if name.database().isDefined() else "default"
        if schema in ("default", "global_temp"):
            self._check_relation(tenant, [name.table()])
        else:
            self._check_relation(tenant, [schema, name.table()])

    def _check_files(self, tenant: str, relation) -> None:
        own = f"{self.file_root}/tenants/{tenant}/" if self.file_root else None
        if relation.getClass().getSimpleName() == "HadoopFsRelation":
            paths = relation.location().rootPaths().iterator()
            plain = lambda p: re.sub(r"^[a-z][a-z0-9+.-]*:/+", "/", p)
            while paths.hasNext():
                if own is None or not plain(f"{paths.next().toString()}/").startswith(plain(own)):
                    raise QueryRefused(f"Access Denied: file access outside tenant '{tenant}' scope.")
        else:
            raise QueryRefused("Access Denied: this kind of source is prohibited.")

    def plan(self, tenant: str, sql: str) -> DataFrame:
        """The statement as a checked, lazy DataFrame."""
        self.check(tenant, sql)
        return self.check_analysed(tenant, self.spark.sql(sql.strip().rstrip(";")))

    def check(self, tenant: str, sql: str) -> list[list[str]]:
        """Relations of an acceptable statement; raises ``QueryRefused`` otherwise."""
        text, tenant = (sql or "").strip().rstrip(";").strip(), tenant.lower()
        if not text:
            raise QueryRefused("Query cannot be empty.", 400)
        relations = self.relations(text)
        for parts in relations:
            self._check_relation(tenant, parts)
        return relations


class QueryResult:
    """A guarded result. Rows stay on the cluster until asked for, at most ``cap`` of them."""

    def __init__(self, df: DataFrame, cap: int = MAX_ROWS):
        self.full, self.cap = df, cap
        self.columns = df.columns

    @property
    def df(self) -> DataFrame:
        return self.full.limit(self.cap)

    def fetch(self) -> tuple[list, bool]:
        """Capped rows and whether more exist; one row past the cap is enough to know."""
        rows = self.full.limit(self.cap + 1).collect()
        return rows[: self.cap], len(rows) > self.cap

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """One page of the capped result; the query must fix a total order."""
        return self.df.offset((number - 1) * size).limit(size)


def tenant_sql(spark: SparkSession, guard: TenantGuard, tenant: str, sql: str, cap: int = MAX_ROWS) -> QueryResult:
    """Check and plan one statement."""
    return QueryResult(guard.plan(tenant, sql), cap)


def capped(df: DataFrame, cap: int = MAX_ROWS) -> DataFrame:
    """A result cut to ``cap`` rows with a ``truncated`` column, in one distributed plan."""
    seen = df.limit(cap + 1)
    more = seen.agg((F.count(F.lit(1)) > cap).alias("truncated"))
    return seen.limit(cap).withColumn("truncated", more.scalar())
