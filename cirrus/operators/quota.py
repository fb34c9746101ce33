"""Quota and limit accounting in long form ``(owner, name, quota, used, available)``.

Unlimited is ``+inf`` (DOUBLE), as in the source data model; ``available`` is
clipped at 0. Tallies are summed with a hash aggregate before joining the quota
table, so the join sees one row per (owner, name) whatever the input size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def normalise_limit(limit: Column) -> Column:
    """Limit None or -1 means unlimited: +inf; otherwise the number as DOUBLE."""
    return F.when(limit.isNull() | (limit == -1), F.lit(INF)).otherwise(limit.cast("double"))


def quota_usage(quotas: DataFrame, tallies: DataFrame, keys: Sequence[str] = ("owner", "name")) -> DataFrame:
    """``quotas``: keys + ``limit``; ``tallies``: keys + ``value`` (null counts 0).

    A finite quota gets ``available`` only once something was tallied for it;
    an untallied name keeps ``used`` null."""
    keys = list(keys)
    used = tallies.groupBy(*keys).agg(F.sum(F.coalesce(F.col("value"), F.lit(0))).cast("bigint").alias("used"))
    q = quotas.select(*keys, normalise_limit(F.col("limit")).alias("quota"))
    return q.join(used, keys, "left").withColumn("available", available(F.col("quota"), F.col("used"))).select(
        *keys, "quota", "used", "available")


def available(quota: Column, used: Column) -> Column:
    """What a quota has left: unlimited, unknown without a tally, else 0 at least."""
    return (F.when(quota == INF, F.lit(INF)).when(used.isNull(), F.lit(None).cast("double"))
            .otherwise(F.greatest(quota - used, F.lit(0.0))))


def with_available(rows: DataFrame) -> DataFrame:
    """Rows with ``limit`` and ``used`` as rows with ``quota``, ``used``, ``available``."""
    others = [c for c in rows.columns if c not in ("limit", "used")]
    quota = rows.select(*others, normalise_limit(F.col("limit")).alias("quota"), "used")
    return quota.withColumn("available", available(F.col("quota"), F.col("used")))


# Fixed values (must equal the reference): quota names of each service.
COMPUTE_QUOTA_FIELDS = ("metadata_items", "cores", "instances", "injected_files", "injected_file_content_bytes",
                        "ram", "floating_ips", "fixed_ips", "security_groups", "security_group_rules")
VOLUME_QUOTA_FIELDS = ("volumes", "snapshots", "gigabytes")
NETWORK_QUOTA_FIELDS = ("network", "subnet", "port", "router", "floatingip", "security_group", "security_group_rule")


# Fixed values (must equal the reference): names that go where a service's setting
# has a value. Settings: enabled, groups (the service provides security groups), quotas.
HIDDEN_WHEN = (
    [("volume", "enabled", False, n) for n in VOLUME_QUOTA_FIELDS]
    + [("network", setting, False, n) for setting in ("enabled", "quotas") for n in NETWORK_QUOTA_FIELDS]
    + [("network", "enabled", True, n) for n in ("floating_ips", "fixed_ips")]
    + [("network", "groups", True, n) for n in ("security_groups", "security_group_rules")]
    + [("network", "groups", False, n) for n in ("security_group", "security_group_rule")]
)


def hide_disabled(usage: DataFrame, settings: DataFrame) -> DataFrame:
    """Quota rows without the names that the services' settings hide. ``settings``
    has (service, setting, value); settings that are not given hide nothing."""
    rules = usage.sparkSession.createDataFrame(HIDDEN_WHEN, "service string, setting string, value boolean, name string")
    return usage.join(rules.join(settings, ["service", "setting", "value"], "left_semi").select("name"), "name", "left_anti")


def drop_quota_names(usage: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the given quota names (a short configuration list: an ``isin``)."""
    return usage.where(~F.col("name").isin(list(names)))


def limits_usage(resources: DataFrame, owner: str, size: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Per owner: gigabytes used (sum of sizes), volumes used (count), plus any
    extra usage counts, all in one aggregate over one scan."""
    return resources.groupBy(owner).agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("gigabytesUsed"),
        F.count(F.lit(1)).alias("volumesUsed"), *extra)


def fraction_used(used: Column, quota: Column, add_count: Column | int = 0, add_size: Column | int = 0) -> tuple[Column, Column]:
    """(percent used, percent used after adding ``add_count`` items of ``add_size``);
    null when the quota is 0 or unlimited."""
    ok = (quota > 0) & (quota != F.lit(INF))
    pct = F.when(ok, F.round(F.lit(100.0) * used / quota, 2))
    added = F.lit(add_count) * F.lit(add_size) if not isinstance(add_count, Column) else add_count * add_size
    pct_after = F.when(ok, F.round(F.lit(100.0) * (used + added) / quota, 2))
    return pct, pct_after


def admission_check(quota: DataFrame, tally: DataFrame) -> DataFrame:
    """``quota``: (tenant_id, instances_limit), ``tally``: (tenant_id, used, requested).
    A request is rejected when it asks for more than the quota has left."""
    j = quota.join(tally, "tenant_id", "left")
    available = F.when(F.col("instances_limit").isNull(), F.lit(INF)).otherwise(
        F.greatest(F.col("instances_limit") - F.coalesce(F.col("used"), F.lit(0)), F.lit(0)).cast("double"))
    requested = F.coalesce(F.col("requested"), F.lit(0)).cast("bigint")
    j = j.select("tenant_id", requested.alias("requested"), available.alias("available"))
    return j.select(
        "tenant_id", "requested", "available", (F.col("requested") <= F.col("available")).alias("admitted"),
        F.when(F.col("requested") > F.col("available"),
               F.concat(F.lit("requested "), F.col("requested").cast("string"), F.lit(" > available "),
                        F.col("available").cast("bigint").cast("string"))).alias("reason"))
