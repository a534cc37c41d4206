"""Row-level read policy of the registry tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADMIN, TENANT_ADMIN = "platform_admin", "tenant_admin"


@dataclass(frozen=True)
class Caller:
    """Who asks; ``None`` stands for an anonymous caller."""

    user_id: str
    role: str
    tenant: str | None = None


def visible_datasets(datasets: DataFrame, caller: Caller | None, tenant: str = "tenant_id") -> DataFrame:
    """Admins see all rows, members the rows of their tenant, others nothing."""
    if caller is not None and caller.role == ADMIN:
        return datasets
    if caller is None or not caller.tenant:
        return datasets.filter(F.lit(False))
    return datasets.filter(F.col(tenant) == caller.tenant)


def visible_tenants(tenants: DataFrame, caller: Caller | None) -> DataFrame:
    """Same rule on the tenant registry itself."""
    return visible_datasets(tenants, caller, tenant="slug")


def visible_users(users: DataFrame, caller: Caller | None) -> DataFrame:
    """Tenant admins see their tenant's users; plain users only themselves."""
    if caller is None:
        return users.filter(F.lit(False))
    if caller.role == ADMIN:
        return users
    if caller.role == TENANT_ADMIN and caller.tenant:
        return users.filter(F.col("tenant") == caller.tenant)
    return users.filter(F.col("user_id") == caller.user_id)


def visible_counts(users: DataFrame, datasets: DataFrame) -> DataFrame:
    """How many dataset rows each user may read.

    Rows are counted per tenant and in total; members join their tenant's one count, so no
    user-by-row pairs arise.
    """
    per_tenant = datasets.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
    everything = datasets.agg(F.count(F.lit(1)).alias("n"))
    admin, member = F.col("role").eqNullSafe(ADMIN), F.col("tenant").isNotNull()
    counted = users.filter(~admin & member).join(per_tenant, F.col("tenant") == F.col("tenant_id"), "left")
    # Users without a key of their own need no join, so they never meet in one task.
    return (
        counted.select("user_id", "role", "tenant", F.coalesce("n", F.lit(0)).alias("visible_rows"))
        .unionAll(users.filter(admin).select("user_id", "role", "tenant", everything.scalar()))
        .unionAll(users.filter(~admin & ~member).select("user_id", "role", "tenant", F.lit(0).cast("long")))
    )
