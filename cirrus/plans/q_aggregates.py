"""Queries for SURVEY section 2.4: aggregations, usage, quota, metering statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirrus.operators import usage as U
from cirrus.operators.joins import lookup
from cirrus.plans import views as V
from cirrus.plans.registry import query
from cirrus.sources.tables import Tables

S = "2.4"


@query("agg_active_usage", section=S, sql=f"""
WITH s AS ({V.SERVERS_SQL})
SELECT s.tenant_id, c.c_name AS tenant_name,
       CAST(count(*) FILTER (WHERE ended_at IS NULL) AS BIGINT) AS instances,
       CAST(coalesce(sum(vcpus) FILTER (WHERE ended_at IS NULL), 0) AS BIGINT) AS active_vcpus,
       CAST(coalesce(sum(memory_mb) FILTER (WHERE ended_at IS NULL), 0) AS BIGINT) AS memory_mb,
       CAST(coalesce(sum(local_gb) FILTER (WHERE ended_at IS NULL), 0) AS BIGINT) AS local_gb,
       round(sum(hours), 2) AS total_hours,
       round(sum(vcpus * hours), 2) AS total_vcpus_usage,
       round(sum(memory_mb * hours), 2) AS total_memory_mb_usage,
       round(sum(local_gb * hours), 2) AS total_local_gb_usage
FROM s LEFT JOIN customer c ON c.c_custkey = s.tenant_id
GROUP BY s.tenant_id, c.c_name
""")
def agg_active_usage(spark, sf_dir):
    """Per tenant: active count and active vcpus/memory/disk, plus usage totals,
    with the tenant (project) name attached."""
    t = Tables(spark, sf_dir)
    usage = U.tenant_usage(V.servers(t.orders))
    names = t.customer.select(F.col("c_custkey").alias("tenant_id"), F.col("c_name").alias("tenant_name"))
    return lookup(usage, names, "tenant_id").select(
        "tenant_id", "tenant_name", "instances", "active_vcpus", "memory_mb", "local_gb",
        "total_hours", "total_vcpus_usage", "total_memory_mb_usage", "total_local_gb_usage")


# --- table summary and usage ---------------------------------------------------------------

@query("agg_summary_row", section=S, sql="""
SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS l_quantity_sum,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / count(l_extendedprice) AS l_extendedprice_average,
       CAST(sum(CAST(l_discount AS DECIMAL(18, 2))) AS DOUBLE) AS l_discount_sum
FROM lineitem
""")
def agg_summary_row(spark, sf_dir):
    """Summary row over the raw, unfiltered column values (nulls ignored)."""
    from cirrus.operators.table import summary_row
    li = Tables(spark, sf_dir).lineitem
    out = summary_row(li, {"l_quantity": "sum_exact", "l_extendedprice": "average_exact", "l_discount": "sum_exact"})
    return out.select(F.col("l_quantity_sum_exact").alias("l_quantity_sum"),
                      F.col("l_extendedprice_average_exact").alias("l_extendedprice_average"),
                      F.col("l_discount_sum_exact").alias("l_discount_sum"))


@query("agg_usage_summary", section=S, sql=f"""
WITH s AS ({V.SERVERS_SQL}),
u AS (SELECT tenant_id,
        count(*) FILTER (WHERE ended_at IS NULL) AS instances,
        coalesce(sum(memory_mb) FILTER (WHERE ended_at IS NULL), 0) AS memory_mb,
        coalesce(sum(local_gb) FILTER (WHERE ended_at IS NULL), 0) AS local_gb,
        round(sum(hours), 2) AS total_hours, round(sum(vcpus * hours), 2) AS total_vcpus_usage,
        round(sum(local_gb * hours), 2) AS total_local_gb_usage
      FROM s GROUP BY tenant_id)
SELECT CAST(sum(instances) AS BIGINT) AS instances, CAST(sum(memory_mb) AS BIGINT) AS memory_mb,
       round(sum(total_vcpus_usage), 2) AS vcpus, round(sum(total_hours), 2) AS vcpu_hours,
       CAST(sum(local_gb) AS BIGINT) AS local_gb, round(sum(total_local_gb_usage), 2) AS disk_gb_hours
FROM u
""")
def agg_usage_summary(spark, sf_dir):
    """Every tenant summary added up; ``vcpus`` is total vcpu usage."""
    return U.usage_summary(U.tenant_usage(V.servers(Tables(spark, sf_dir).orders)))


@query("agg_flatten_usage", section=S, sql="""
SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings
""")
def agg_flatten_usage(spark, sf_dir):
    """A nested column (arrays of structs, here a vector's components) flattened to
    rows (``inline``), without a shuffle."""
    e = Tables(spark, sf_dir).embeddings
    nested = e.select("vec_id", F.transform("embedding", lambda x, i: F.struct(
        i.alias("pos"), x.cast("double").alias("value"))).alias("server_usages"))
    return U.flatten_usage(nested, "server_usages", ["vec_id"])


# --- metering statistics ------------------------------------------------------------------

SAMPLES_SQL = "SELECT ts, event_type AS meter, user_id AS resource, value AS volume, event_id, props FROM events"


def samples(t: Tables):
    return t.events.select("ts", F.col("event_type").alias("meter"), F.col("user_id").alias("resource"),
                           F.col("value").alias("volume"), "event_id", "props")


STATS_SQL = ("count(*) AS count, min(volume) AS min, max(volume) AS max, round(sum(volume), 2) AS sum, "
             "round(sum(volume), 2) / count(*) AS avg, min(ts) AS duration_start, max(ts) AS duration_end")


@query("stat_whole_range", section=S, sql=f"""
SELECT resource, meter, {STATS_SQL} FROM ({SAMPLES_SQL}) GROUP BY resource, meter
""")
def stat_whole_range(spark, sf_dir):
    """One statistic per (resource, meter) over the whole range: count, min, max, sum, avg,
    first and last sample time."""
    from cirrus.operators import metering as M
    return M.stats_whole_range(samples(Tables(spark, sf_dir)), ["resource", "meter"])


PERIOD_ORIGIN = "2024-01-01 00:00:00"


@query("stat_by_period", section=S, sql=f"""
WITH b AS (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '{PERIOD_ORIGIN}')) // 86400000000 AS bucket
           FROM ({SAMPLES_SQL}))
SELECT resource, meter, TIMESTAMP '{PERIOD_ORIGIN}' + to_seconds(bucket * 86400) AS period_start,
       TIMESTAMP '{PERIOD_ORIGIN}' + to_seconds(bucket * 86400 + 86400) AS period_end,
       CAST(86400 AS BIGINT) AS period, {STATS_SQL}
FROM b GROUP BY resource, meter, bucket
""")
def stat_by_period(spark, sf_dir):
    """Statistics per day counted from the query's lower bound; empty days absent."""
    import datetime as dt
    from cirrus.operators import metering as M
    return M.stats_by_period(samples(Tables(spark, sf_dir)), ["resource", "meter"], 86400,
                             dt.datetime(2024, 1, 1))


ODD_ORIGIN = "2024-01-02 03:17:25"


@query("stat_by_period_rollup", section=S, sql=f"""
WITH b AS (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '{ODD_ORIGIN}')) // 50000000000 AS bucket
           FROM ({SAMPLES_SQL}) WHERE ts >= TIMESTAMP '{ODD_ORIGIN}')
SELECT resource, meter, TIMESTAMP '{ODD_ORIGIN}' + to_seconds(bucket * 50000) AS period_start,
       TIMESTAMP '{ODD_ORIGIN}' + to_seconds(bucket * 50000 + 50000) AS period_end,
       CAST(50000 AS BIGINT) AS period, {STATS_SQL}
FROM b GROUP BY resource, meter, bucket
""")
def stat_by_period_rollup(spark, sf_dir):
    """Statistics per 50,000 seconds from an odd lower bound, answered from a pyramid of
    minutes, hours and days; raw samples are read at the borders only."""
    import datetime as dt
    from cirrus.operators import rollup as R
    from cirrus.session import scratch_dir
    pyramid = R.build(samples(Tables(spark, sf_dir)), ["resource", "meter"], scratch_dir(spark, "pyramid"))
    return R.stats_by_period(pyramid, 50_000, dt.datetime.fromisoformat(ODD_ORIGIN))


@query("stat_selected_attr", section=S, sql=f"""
SELECT resource, meter, round(sum(volume), 2) / count(*) AS avg FROM ({SAMPLES_SQL}) GROUP BY resource, meter
""")
def stat_selected_attr(spark, sf_dir):
    """Keep one attribute (the average) of each (resource, meter) statistic."""
    from cirrus.operators import metering as M
    st = M.stats_whole_range(samples(Tables(spark, sf_dir)), ["resource", "meter"])
    return M.select_attr(st, ["resource", "meter"], "avg")


#: Meters shown side by side.
METERS = ["event.click", "event.error", "event.purchase", "event.signup", "event.view"]


@query("stat_meters_wide", section=S, sql=f"""
SELECT resource,
       round(sum(volume) FILTER (WHERE meter = 'event.click'), 2) / count(*) FILTER (WHERE meter = 'event.click') AS event_click,
       round(sum(volume) FILTER (WHERE meter = 'event.error'), 2) / count(*) FILTER (WHERE meter = 'event.error') AS event_error,
       round(sum(volume) FILTER (WHERE meter = 'event.purchase'), 2) / count(*) FILTER (WHERE meter = 'event.purchase') AS event_purchase,
       round(sum(volume) FILTER (WHERE meter = 'event.signup'), 2) / count(*) FILTER (WHERE meter = 'event.signup') AS event_signup,
       round(sum(volume) FILTER (WHERE meter = 'event.view'), 2) / count(*) FILTER (WHERE meter = 'event.view') AS event_view
FROM (SELECT user_id AS resource, 'event.' || event_type AS meter, value AS volume FROM events)
GROUP BY resource
""")
def stat_meters_wide(spark, sf_dir):
    """One column per meter of METERS (average volume); '.' in meter names becomes
    '_'. The columns wanted are a parameter, as a chart's meters are."""
    from cirrus.operators import metering as M
    s = samples(Tables(spark, sf_dir)).withColumn("meter", F.concat(F.lit("event."), "meter"))
    return M.meters_wide(s, "resource", "meter", METERS)


@query("stat_named_groups", section=S, sql=f"""
SELECT c.c_mktsegment AS group_name, s.meter, {STATS_SQL}
FROM ({SAMPLES_SQL}) s JOIN customer c ON c.c_custkey = s.resource
GROUP BY c.c_mktsegment, s.meter
""")
def stat_named_groups(spark, sf_dir):
    """Statistics for each named group of resources (customers by market segment)."""
    from cirrus.operators import metering as M
    from cirrus.operators.joins import lookup
    t = Tables(spark, sf_dir)
    groups = t.customer.select(F.col("c_custkey").alias("resource"), F.col("c_mktsegment").alias("group_name"))
    return M.stats_whole_range(lookup(samples(t), groups, "resource", how="inner"), ["group_name", "meter"])


# --- quota and limits ------------------------------------------------------------------------

#: Quotas beside the server ones: a limit per tenant, or -1.
FIXED_LIMITS = {"floating_ips": 10, "volumes": 8, "snapshots": -1, "gigabytes": 1000, "security_groups": 10}
#: A tenant's events stand for its addresses (click), volumes (purchase) and snapshots (signup).
QUOTA_SQL = f"""
WITH q AS ({V.TENANT_QUOTA_SQL}),
s AS (SELECT tenant_id, count(*) AS inst, sum(vcpus) AS cores, sum(memory_mb) AS ram
      FROM ({V.SERVERS_SQL}) WHERE state <> 'deleted' GROUP BY tenant_id),
e AS (SELECT user_id AS tenant_id, count(*) FILTER (WHERE event_type = 'click') AS ips,
             count(*) FILTER (WHERE event_type = 'purchase') AS volumes, count(*) FILTER (WHERE event_type = 'signup') AS snapshots,
             sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_type = 'purchase') AS gigabytes
      FROM events GROUP BY user_id),
w AS (SELECT q.tenant_id, instances_limit AS lim, s.*, e.* FROM q LEFT JOIN s ON s.tenant_id = q.tenant_id
      LEFT JOIN e ON e.tenant_id = q.tenant_id),
j AS (SELECT tenant_id, 'instances' AS name, lim, CAST(coalesce(inst, 0) AS BIGINT) AS used FROM w
      UNION ALL SELECT tenant_id, 'cores', 4 * lim, CAST(coalesce(cores, 0) AS BIGINT) FROM w
      UNION ALL SELECT tenant_id, 'ram', 4096 * lim, CAST(coalesce(ram, 0) AS BIGINT) FROM w
      UNION ALL SELECT tenant_id, 'floating_ips', 10, CAST(coalesce(ips, 0) AS BIGINT) FROM w
      UNION ALL SELECT tenant_id, 'volumes', 8, CAST(coalesce(volumes, 0) AS BIGINT) FROM w
      UNION ALL SELECT tenant_id, 'snapshots', NULL, CAST(coalesce(snapshots, 0) AS BIGINT) FROM w
      UNION ALL SELECT tenant_id, 'gigabytes', 1000, CAST(coalesce(gigabytes, 0) AS BIGINT) FROM w
      UNION ALL SELECT tenant_id, 'security_groups', 10, NULL FROM w),
k AS (SELECT tenant_id, name, coalesce(CAST(lim AS DOUBLE), 'inf'::DOUBLE) AS quota, used FROM j)
SELECT tenant_id, name, quota, used,
       CASE WHEN quota = 'inf'::DOUBLE THEN 'inf'::DOUBLE WHEN used IS NULL THEN NULL
            ELSE greatest(quota - used, 0.0) END AS available
FROM k"""


def quota_usage_df(t: Tables, only: str | None = None):
    """The tallies meet the tenants once, wide; the names are stacked last. ``only``
    leaves the other names out before that."""
    from cirrus.operators import quota as QU
    event = F.col("event_type")
    servers = V.servers(t.orders).where("state <> 'deleted'").groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("instances"), F.sum("vcpus").alias("cores"), F.sum("memory_mb").alias("ram"))
    other = t.events.groupBy(F.col("user_id").alias("tenant_id")).agg(
        F.count_if(event == "click").alias("floating_ips"), F.count_if(event == "purchase").alias("volumes"),
        F.count_if(event == "signup").alias("snapshots"),
        F.sum(F.when(event == "purchase", F.floor("value").cast("bigint"))).alias("gigabytes"))
    per_server = {"instances": 1, "cores": 4, "ram": 4096}
    names = [n for n in [*per_server, *FIXED_LIMITS] if only in (None, n)]
    wide = V.tenant_quota(t.customer).select("tenant_id", "instances_limit")
    if only in (None, *per_server):
        wide = wide.join(servers, "tenant_id", "left")
    if only in (None, *FIXED_LIMITS):
        wide = wide.join(other, "tenant_id", "left")
    rows = F.array(*[F.struct(
        F.lit(n).alias("name"), (F.col("instances_limit") * per_server[n] if n in per_server
                                 else F.lit(FIXED_LIMITS[n]).cast("bigint")).alias("limit"),
        (F.lit(None).cast("bigint") if n == "security_groups" else F.coalesce(F.col(n), F.lit(0)).cast("bigint")).alias("used"))
        for n in names])
    return QU.with_available(wide.select("tenant_id", F.inline(rows)))


@query("quota_usage", section=S, sql=QUOTA_SQL)
def quota_usage(spark, sf_dir):
    """Per tenant and quota name: quota (inf = unlimited), used, available (>= 0);
    'security_groups' is never tallied, so it keeps no used/available."""
    return quota_usage_df(Tables(spark, sf_dir))


@query("quota_disable_by_service", section=S, sql=f"""
SELECT * FROM ({QUOTA_SQL})
WHERE name NOT IN ('floating_ips', 'fixed_ips', 'security_groups', 'security_group_rules')
""")
def quota_disable_by_service(spark, sf_dir):
    """Quota rows without the names of services that are off or superseded:
    volume and network on, security groups and quotas from the network
    service, so the compute service's address and security-group names go."""
    from cirrus.operators import quota as QU
    settings = spark.createDataFrame([("volume", "enabled", True), ("network", "enabled", True), ("network", "groups", True),
                                      ("network", "quotas", True)], "service string, setting string, value boolean")
    return QU.hide_disabled(quota_usage_df(Tables(spark, sf_dir)), settings).select(
        "tenant_id", "name", "quota", "used", "available")


@query("limits_usage", section=S, sql="""
SELECT l_suppkey AS tenant_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS gigabytesUsed,
       count(*) AS volumesUsed, count(DISTINCT l_orderkey) AS floatingIpsUsed,
       count(DISTINCT l_partkey) AS securityGroupsUsed
FROM lineitem GROUP BY l_suppkey
""")
def limits_usage(spark, sf_dir):
    """Usage added to limits per tenant (supplier): gigabytes and volumes used,
    addresses and groups used (distinct counts)."""
    from cirrus.operators import quota as QU
    li = Tables(spark, sf_dir).lineitem.select(F.col("l_suppkey").alias("tenant_id"),
                                               F.col("l_quantity").cast("bigint").alias("size"),
                                               "l_orderkey", "l_partkey")
    # one distinct count rides with the sums, the other is counted by itself: no row is tripled
    base = QU.limits_usage(li, "tenant_id", "size", extra=[F.count_distinct("l_orderkey").alias("floatingIpsUsed")])
    groups = li.groupBy("tenant_id").agg(F.count_distinct("l_partkey").alias("securityGroupsUsed"))
    return base.join(groups, "tenant_id")


@query("limits_normalise", section=S, sql="""
SELECT p_brand, 'max_' || lower(p_type) AS name,
       max(CASE WHEN p_size > 45 THEN 'inf'::DOUBLE ELSE CAST(p_size AS DOUBLE) END) AS limit_value
FROM part GROUP BY p_brand, 'max_' || lower(p_type)
""")
def limits_normalise(spark, sf_dir):
    """Name/value limit rows, -1 (here: size above 45) normalised to +inf."""
    from cirrus.operators import quota as QU
    p = Tables(spark, sf_dir).part.select(
        "p_brand", F.concat(F.lit("max_"), F.lower("p_type")).alias("name"),
        F.when(F.col("p_size") > 45, F.lit(-1)).otherwise(F.col("p_size")).alias("value"))
    return p.groupBy("p_brand", "name").agg(F.max(QU.normalise_limit(F.col("value"))).alias("limit_value"))


@query("quota_fraction", section=S, sql=f"""
WITH u AS (SELECT tenant_id, name, quota, used FROM ({QUOTA_SQL}) WHERE name = 'cores')
SELECT tenant_id, used, quota,
       CASE WHEN quota > 0 AND quota <> 'inf'::DOUBLE THEN round(100.0 * used / quota, 2) END AS pct_used,
       CASE WHEN quota > 0 AND quota <> 'inf'::DOUBLE THEN round(100.0 * (used + 2 * 4) / quota, 2) END AS pct_after
FROM u
""")
def quota_fraction(spark, sf_dir):
    """Percent of the cores quota used, and after adding 2 servers of 4 vcpus."""
    from cirrus.operators import quota as QU
    u = quota_usage_df(Tables(spark, sf_dir), only="cores")
    pct, after = QU.fraction_used(F.col("used"), F.col("quota"), 2, 4)
    return u.select("tenant_id", "used", "quota", pct.alias("pct_used"), after.alias("pct_after"))


# --- counts ---------------------------------------------------------------------------------

@query("count_categories", section=S, sql="""
WITH c AS (SELECT unnest(list_filter([CASE WHEN lang = 'en' THEN 'public' END,
             CASE WHEN source = 'src1' THEN 'project' WHEN source IN ('src2', 'src3') THEN source
                  WHEN NOT coalesce(lang = 'en', false) THEN 'shared' END], lambda x: x IS NOT NULL)) AS category
           FROM documents),
b AS (SELECT * FROM (VALUES ('project'), ('src2'), ('src3'), ('shared'), ('public')) t(category))
SELECT b.category, CAST(count(c.category) AS BIGINT) AS n FROM b LEFT JOIN c ON c.category = b.category
GROUP BY b.category
""")
def count_categories(spark, sf_dir):
    """Multi-label ownership categories per document, counted for each filter
    button (project, the named tenants, shared, public); empty buttons show 0."""
    from cirrus.operators.table import category_counts
    from cirrus.plans.q_filters import FILTER_TENANTS, doc_categories
    d = Tables(spark, sf_dir).documents.select(doc_categories().alias("cats"))
    return category_counts(d, "cats", ["project", *FILTER_TENANTS, "shared", "public"])


@query("count_rows_shown", section=S, sql="""
SELECT count(*) AS n_rows FROM orders WHERE o_orderstatus = 'O'
""")
def count_rows_shown(spark, sf_dir):
    """Row count of the filtered table (open orders), as the table footer shows it."""
    return Tables(spark, sf_dir).orders.where(F.col("o_orderstatus") == "O").agg(F.count(F.lit(1)).alias("n_rows"))


@query("count_group_members", section=S, sql="""
SELECT o_custkey AS group_id, count(*) AS instances,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS live, count(*) FILTER (WHERE o_orderstatus = 'P') AS jobs
FROM orders GROUP BY o_custkey
""")
def count_group_members(spark, sf_dir):
    """Per group (customer): instances, live instances and queued jobs."""
    o = Tables(spark, sf_dir).orders
    return o.groupBy(F.col("o_custkey").alias("group_id")).agg(
        F.count(F.lit(1)).alias("instances"), F.count_if(F.col("o_orderstatus") == "O").alias("live"),
        F.count_if(F.col("o_orderstatus") == "P").alias("jobs"))


@query("container_totals", section=S, sql="""
SELECT source AS container, count(*) AS object_count, CAST(sum(n_chars) AS BIGINT) AS bytes_used
FROM documents GROUP BY source
""")
def container_totals(spark, sf_dir):
    """Object count and bytes used per container (documents by source)."""
    d = Tables(spark, sf_dir).documents
    return d.groupBy(F.col("source").alias("container")).agg(
        F.count(F.lit(1)).alias("object_count"), F.sum("n_chars").cast("bigint").alias("bytes_used"))


HYPERVISORS_SQL = """SELECT s_suppkey, 16 + s_suppkey % 48 AS vcpus, 1024 * (32 + s_nationkey) AS memory_mb,
  100 * (1 + s_suppkey % 10) AS local_gb, CAST(floor(abs(s_acctbal) / 100) AS INTEGER) AS running_vms FROM supplier"""


@query("fleet_totals", section=S, sql=f"""
SELECT count(*) AS count, CAST(sum(vcpus) AS BIGINT) AS vcpus, CAST(sum(memory_mb) AS BIGINT) AS memory_mb,
       CAST(sum(local_gb) AS BIGINT) AS local_gb, CAST(sum(running_vms) AS BIGINT) AS running_vms
FROM ({HYPERVISORS_SQL})
""")
def fleet_totals(spark, sf_dir):
    """Totals over hypervisors (suppliers): count, vcpus, memory, disk, running."""
    s = Tables(spark, sf_dir).supplier
    h = s.select((16 + F.col("s_suppkey") % 48).alias("vcpus"), (1024 * (32 + F.col("s_nationkey"))).alias("memory_mb"),
                 (100 * (1 + F.col("s_suppkey") % 10)).alias("local_gb"),
                 (F.abs("s_acctbal") / 100).cast("int").alias("running_vms"))
    return h.agg(F.count(F.lit(1)).alias("count"), *[F.sum(c).cast("bigint").alias(c)
                                                    for c in ("vcpus", "memory_mb", "local_gb", "running_vms")])


@query("collect_distinct_ids", section=S, sql="""
SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS group_ids
FROM lineitem GROUP BY l_orderkey
""")
def collect_distinct_ids(spark, sf_dir):
    """Distinct group ids over all ports of a server (parts over an order's lines)."""
    from cirrus.operators.enrich import bounded, collect_list
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_partkey")
    return bounded(li, "l_orderkey", distinct="l_partkey").groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(collect_list(F.col("l_partkey"), distinct=True)).cast("array<string>"), ",").alias("group_ids"))


LINE_SQL = ("'10.' || CAST(l_suppkey % 256 AS VARCHAR) || '.' || CAST(l_partkey % 256 AS VARCHAR) || '.' "
            "|| CAST(l_linenumber AS VARCHAR) || ' node-' || CAST(l_linenumber AS VARCHAR)")


@query("concat_lines", section=S, sql=f"""
SELECT l_orderkey, string_agg({LINE_SQL}, chr(10) ORDER BY {LINE_SQL}) AS hosts
FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey
""")
def concat_lines(spark, sf_dir):
    """One hosts text per cluster (order): 'ip name' lines for members that have
    an address (returned lines have none), sorted, newline separated. A
    cluster's member list is bounded by the cluster size."""
    li = Tables(spark, sf_dir).lineitem
    ip = F.when(F.col("l_returnflag") != "R", F.concat(
        F.lit("10."), (F.col("l_suppkey") % 256).cast("string"), F.lit("."), (F.col("l_partkey") % 256).cast("string"),
        F.lit("."), F.col("l_linenumber").cast("string")))
    line = F.concat(ip, F.lit(" node-"), F.col("l_linenumber").cast("string"))
    from cirrus.operators.enrich import bounded, collect_list
    members = li.select("l_orderkey", line.alias("line")).where(F.col("line").isNotNull())
    return bounded(members, "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.sort_array(collect_list(F.col("line"))), "\n").alias("hosts"))


@query("all_services_up", section=S, sql="""
SELECT l_orderkey,
       'host-' || CAST(l_orderkey AS VARCHAR) || ' ('
       || CASE WHEN bool_and(l_linestatus = 'F' AND l_returnflag <> 'R') THEN 'Services Up' ELSE 'Services Down' END
       || ')' AS host_status
FROM lineitem GROUP BY l_orderkey
""")
def all_services_up(spark, sf_dir):
    """A host is up only if every service on it is active and available."""
    from cirrus.functions.status import all_true
    li = Tables(spark, sf_dir).lineitem
    up = all_true((F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "R"))
    agg = li.groupBy("l_orderkey").agg(up.alias("up"))
    return agg.select("l_orderkey", F.concat(F.lit("host-"), F.col("l_orderkey").cast("string"), F.lit(" ("),
                                             F.when(F.col("up"), "Services Up").otherwise("Services Down"),
                                             F.lit(")")).alias("host_status"))


# --- batch text jobs ------------------------------------------------------------------------

@query("word_count", section=S, sql="""
SELECT word, count(*) AS count FROM (
  SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM documents)
WHERE word <> '' GROUP BY word
""")
def word_count(spark, sf_dir):
    """Count of each token over the whole texts (tokenizer delimiters: space, tab, CR, LF, FF)."""
    from cirrus.operators import jobs as J
    return J.word_count(Tables(spark, sf_dir).documents, "text")


@query("stream_map_reduce", section=S, sql="""
SELECT word, count(*) AS count FROM (
  SELECT unnest(regexp_split_to_array(text, '[ \t\n]+')) AS word FROM documents)
WHERE word <> '' GROUP BY word
""")
def stream_map_reduce(spark, sf_dir):
    """A user mapper (pandas, per piece of an Arrow batch) splits lines on blanks and
    emits (word, 1); counts are combined per piece, then summed per word by Spark."""
    from cirrus.operators import jobs as J
    d = Tables(spark, sf_dir).documents.select("text")
    return J.map_reduce(d, J.awk_word_mapper("text"), "word string, count long", "word", "count", "sum")
