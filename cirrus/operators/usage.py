"""Usage accounting: per-tenant usage records, summaries and report columns.

Input is a server-usage table with columns ``tenant_id, vcpus, memory_mb,
local_gb, hours, ended_at`` (``ended_at`` null = still active). All operators
are hash aggregates: Spark combines partially on the map side, so a tenant that
owns a third of all servers still ships one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_active(ended_at: str = "ended_at") -> Column:
    return F.col(ended_at).isNull()


def filter_active_only(servers: DataFrame, show_terminated: bool = False) -> DataFrame:
    """Hide terminated rows unless ``show_terminated``."""
    return servers if show_terminated else servers.where(is_active())


def in_period(servers: DataFrame, start, end) -> DataFrame:
    """Servers that ran during [start, end]: started by the end and not ended
    before the start. The start bound reaches the scan as a pushed filter."""
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return servers.where((F.col("started_at") <= e) & (F.col("ended_at").isNull() | (F.col("ended_at") >= s)))


def tenant_usage(servers: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """One record per tenant: the totals the usage service returns (``total_*``)
    plus the active-only sums the summary reads."""
    active = is_active()
    zero = F.lit(0)
    return servers.groupBy(tenant).agg(
        F.count_if(active).alias("instances"),
        F.coalesce(F.sum(F.when(active, F.col("vcpus"))), zero).cast("bigint").alias("active_vcpus"),
        F.coalesce(F.sum(F.when(active, F.col("memory_mb"))), zero).cast("bigint").alias("memory_mb"),
        F.coalesce(F.sum(F.when(active, F.col("local_gb"))), zero).cast("bigint").alias("local_gb"),
        F.round(F.sum("hours"), 2).alias("total_hours"),
        F.round(F.sum(F.col("vcpus") * F.col("hours")), 2).alias("total_vcpus_usage"),
        F.round(F.sum(F.col("memory_mb") * F.col("hours")), 2).alias("total_memory_mb_usage"),
        F.round(F.sum(F.col("local_gb") * F.col("hours")), 2).alias("total_local_gb_usage"),
    )


def usage_summary(usage: DataFrame) -> DataFrame:
    """Add every tenant summary into one row. Note ``vcpus`` is the total vcpu
    usage (vcpu-hours) while ``instances``/``memory_mb``/``local_gb`` are the
    active-only sums, exactly as the per-tenant summary defines them."""
    return usage.agg(
        F.sum("instances").cast("bigint").alias("instances"),
        F.sum("memory_mb").cast("bigint").alias("memory_mb"),
        F.round(F.sum("total_vcpus_usage"), 2).alias("vcpus"),
        F.round(F.sum("total_hours"), 2).alias("vcpu_hours"),
        F.sum("local_gb").cast("bigint").alias("local_gb"),
        F.round(F.sum("total_local_gb_usage"), 2).alias("disk_gb_hours"),
    )


def flatten_usage(nested: DataFrame, array_col: str, keep: list[str]) -> DataFrame:
    """Flatten per-owner arrays of usage structs into one row per element."""
    return nested.select(*keep, F.inline(array_col))


def uptime_at(uptime_seconds: Column, now: Column) -> Column:
    """``now - uptime`` as a timestamp."""
    return F.timestamp_add("SECOND", -uptime_seconds.cast("bigint"), now)


def record_summary(records: DataFrame, tenant: str = "tenant_id", servers: str = "server_usages") -> DataFrame:
    """Per-tenant summary of usage records in the service's shape (totals plus an
    array of per-server usage): instances, memory_mb and local_gb count active
    servers only; vcpus, vcpu_hours and disk_gb_hours are the record's totals.
    The server arrays are flattened and aggregated (partial, map-side), never
    processed as one array per tenant."""
    active = is_active()
    flat = records.select(F.col(tenant).alias("_owner"), F.inline(servers))
    act = flat.groupBy(F.col("_owner").alias(tenant)).agg(
        F.count_if(active).alias("instances"),
        F.sum(F.when(active, F.col("memory_mb"))).alias("memory_mb"),
        F.sum(F.when(active, F.col("local_gb"))).alias("local_gb"))
    totals = records.select(tenant, F.coalesce(F.col("total_vcpus_usage"), F.lit(0.0)).alias("vcpus"),
                            F.coalesce(F.col("total_hours"), F.lit(0.0)).alias("vcpu_hours"),
                            F.coalesce(F.col("total_local_gb_usage"), F.lit(0.0)).alias("disk_gb_hours"))
    j = totals.join(act, tenant, "left")
    zero = F.lit(0)
    return j.select(tenant, F.coalesce("instances", zero).cast("bigint").alias("instances"),
                    F.coalesce("memory_mb", zero).cast("bigint").alias("memory_mb"), "vcpus", "vcpu_hours",
                    F.coalesce("local_gb", zero).cast("bigint").alias("local_gb"), "disk_gb_hours")


def add_summaries(summary: DataFrame) -> DataFrame:
    """Add every tenant summary into one row (the global usage summary)."""
    return summary.agg(*[F.sum(c).alias(c) for c in
                         ("instances", "memory_mb", "vcpus", "vcpu_hours", "local_gb", "disk_gb_hours")])
