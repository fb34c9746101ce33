"""Queries for SURVEY section 2.1: sources and sinks.

Sinks are exercised as write-then-read round trips into a fresh folder under the
shared checkpoint root, so the oracle checks what a reader of the sink sees.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirrus.functions import display as D
from cirrus.operators import jobs as J
from cirrus.operators import metering as M
from cirrus.operators import usage as U
from cirrus.plans import views as V
from cirrus.plans.q_aggregates import PERIOD_ORIGIN, samples
from cirrus.plans.registry import query
from cirrus.session import scratch_dir
from cirrus.sources import files as FS
from cirrus.sources.tables import Tables, table_path

S = "2.1"


@query("src_typed_records", section=S, sql="""
SELECT c_custkey, c_name, c_acctbal, CAST(NULL AS VARCHAR) AS c_phone FROM customer
""")
def src_typed_records(spark, sf_dir):
    """Declared attributes only; a declared attribute absent from the files is null."""
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
                           T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_phone", T.StringType())])
    return FS.read_typed(spark, table_path(sf_dir, "customer"), schema)


@query("src_json_meta", section=S, sql="""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def src_json_meta(spark, sf_dir):
    """JSON metadata objects parsed with a declared schema (in-table form)."""
    e = Tables(spark, sf_dir).events
    return e.select("event_id", FS.parse_json_meta("props", "k BIGINT")["k"].alias("k"))


@query("src_object_listing", section=S, sql="""
SELECT source AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, true AS dated FROM documents GROUP BY source
""")
def src_object_listing(spark, sf_dir):
    """Objects (files) under a prefix as (name, bytes, last_modified), listed without
    reading their contents: the documents written as text, a folder for each source,
    and the listing summed by folder."""
    out = scratch_dir(spark, "listing")
    FS.write_partitioned(Tables(spark, sf_dir).documents.select("source", "text"), out, "source", fmt="text")
    listing = FS.list_objects(spark, out, glob="part-*")
    return listing.groupBy(F.regexp_extract("name", "^source=([^/]*)/", 1).alias("folder")).agg(
        F.sum("bytes").alias("bytes"), F.bool_and(F.col("last_modified").isNotNull()).alias("dated"))


@query("src_text", section=S, sql="""
SELECT unnest(string_split(text, chr(10))) AS value FROM documents
""")
def src_text(spark, sf_dir):
    """Text input of the batch jobs: whole documents written as text files and
    read back line by line."""
    out = scratch_dir(spark, "text")
    FS.write_text(Tables(spark, sf_dir).documents, "text", out)
    return FS.read_text(spark, out)


def _gen_text_sql(words: int = 8) -> str:
    syl = "[" + ", ".join(f"'{x}'" for x in J.SYLLABLES) + "]"
    n = len(J.SYLLABLES)
    out = []
    for j in range(words):
        h = f"(((range * {words} + {j}) * 48271) % 2147483647)"
        out.append(f"{syl}[{h} % {n} + 1] || {syl}[({h} // {n}) % {n} + 1] || "
                   f"CASE WHEN {h} % 3 = 0 THEN {syl}[({h} // {n * n}) % {n} + 1] ELSE '' END")
    return " || ' ' || ".join(f"({w})" for w in out)


@query("gen_rows", section=S, sql=f"""
SELECT range AS id, lpad(CAST((range * 48271) % 2147483647 AS VARCHAR), 10, '0') AS key,
       'payload-' || CAST(range AS VARCHAR) AS payload, {_gen_text_sql()} AS text
FROM range((SELECT count(*) FROM lineitem))
""")
def gen_rows(spark, sf_dir):
    """Generated sortable rows with random-looking text, as many as lineitem has
    (the sort job's and the word count's input)."""
    n = Tables(spark, sf_dir).lineitem.count()
    return J.gen_rows(spark, n)


USAGE_SCHEMA = ("tenant_id BIGINT, tenant_name STRING, instances BIGINT, active_vcpus BIGINT, memory_mb BIGINT, "
                "local_gb BIGINT, total_hours DOUBLE, total_vcpus_usage DOUBLE, total_memory_mb_usage DOUBLE, "
                "total_local_gb_usage DOUBLE")


@query("sink_csv_report", section=S, sql=f"""
WITH s AS ({V.SERVERS_SQL})
SELECT s.tenant_id, c.c_name AS tenant_name,
       CAST(count(*) FILTER (WHERE ended_at IS NULL) AS BIGINT) AS instances,
       CAST(coalesce(sum(vcpus) FILTER (WHERE ended_at IS NULL), 0) AS BIGINT) AS active_vcpus,
       CAST(coalesce(sum(memory_mb) FILTER (WHERE ended_at IS NULL), 0) AS BIGINT) AS memory_mb,
       CAST(coalesce(sum(local_gb) FILTER (WHERE ended_at IS NULL), 0) AS BIGINT) AS local_gb,
       round(sum(hours), 2) AS total_hours, round(sum(vcpus * hours), 2) AS total_vcpus_usage,
       round(sum(memory_mb * hours), 2) AS total_memory_mb_usage, round(sum(local_gb * hours), 2) AS total_local_gb_usage
FROM s LEFT JOIN customer c ON c.c_custkey = s.tenant_id
GROUP BY s.tenant_id, c.c_name
""")
def sink_csv_report(spark, sf_dir):
    """Usage report written as CSV with a header row, read back with its schema."""
    from cirrus.plans.registry import QUERIES
    out = scratch_dir(spark, "csv_report")
    FS.write_csv_report(QUERIES["agg_active_usage"](spark, sf_dir), out)
    return FS.read_csv_report(spark, out, USAGE_SCHEMA)


REPORT_START, REPORT_END = "1998-01-01 00:00:00", "1998-12-31 23:59:59"


@query("sink_project_csv", section=S, sql=f"""
WITH s AS (SELECT * FROM ({V.SERVERS_SQL})
           WHERE started_at <= TIMESTAMP '{REPORT_END}'
             AND (ended_at IS NULL OR ended_at >= TIMESTAMP '{REPORT_START}'))
SELECT coalesce(c.c_name, CAST(s.tenant_id AS VARCHAR)) AS project,
       CAST(coalesce(sum(vcpus) FILTER (WHERE ended_at IS NULL), 0) AS BIGINT) AS vcpus,
       CAST(coalesce(sum(memory_mb) FILTER (WHERE ended_at IS NULL), 0) AS BIGINT) AS ram,
       CAST(coalesce(sum(local_gb) FILTER (WHERE ended_at IS NULL), 0) AS BIGINT) AS disk,
       round(sum(hours), 2) AS hours
FROM s LEFT JOIN customer c ON c.c_custkey = s.tenant_id
GROUP BY s.tenant_id, c.c_name
""")
def sink_project_csv(spark, sf_dir):
    """Project report for a period (1998, whole days): name (or id), vcpus, ram,
    disk, hours to two places; servers count when they ran during the period."""
    t = Tables(spark, sf_dir)
    u = U.tenant_usage(U.in_period(V.servers(t.orders), REPORT_START, REPORT_END))
    names = t.customer.select(F.col("c_custkey").alias("tenant_id"), "c_name")
    rep = u.join(names, "tenant_id", "left").select(
        F.coalesce("c_name", F.col("tenant_id").cast("string")).alias("project"),
        F.col("active_vcpus").alias("vcpus"), F.col("memory_mb").alias("ram"), F.col("local_gb").alias("disk"),
        F.round("total_hours", 2).alias("hours"))
    out = scratch_dir(spark, "project_csv")
    FS.write_csv_report(rep, out)
    return FS.read_csv_report(spark, out, "project STRING, vcpus BIGINT, ram BIGINT, disk BIGINT, hours DOUBLE")


@query("sink_instance_csv", section=S, sql=f"""
SELECT name, vcpus, memory_mb AS ram, local_gb AS disk, printf('%.2f', hours) AS hours, uptime,
       upper(substring(state, 1, 1)) || substring(state, 2) AS state
FROM ({V.SERVERS_SQL})
""")
def sink_instance_csv(spark, sf_dir):
    """Instance report: name, vcpus, ram, disk, hours (2 places), uptime, State."""
    s = V.servers(Tables(spark, sf_dir).orders)
    rep = s.select("name", "vcpus", F.col("memory_mb").alias("ram"), F.col("local_gb").alias("disk"),
                   F.format_string("%.2f", "hours").alias("hours"), "uptime", D.capfirst(F.col("state")).alias("state"))
    out = scratch_dir(spark, "instance_csv")
    FS.write_csv_report(rep, out)
    return FS.read_csv_report(spark, out, "name STRING, vcpus INT, ram INT, disk INT, hours STRING, uptime BIGINT, "
                                          "state STRING")


@query("sink_series_json", section=S, sql=f"""
WITH b AS (SELECT user_id, value, ts,
                  (epoch_us(ts) - epoch_us(TIMESTAMP '{PERIOD_ORIGIN}')) // 86400000000 AS bucket FROM events)
SELECT 'resource-' || CAST(user_id AS VARCHAR) AS name, 'value' AS unit,
       strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS x, round(sum(value), 2) / count(*) AS y
FROM b GROUP BY user_id, bucket
""")
def sink_series_json(spark, sf_dir):
    """Chart series as JSON lines, one ``{name, unit, data: [{x, y}]}`` object per
    resource (the settings envelope is presentation); read back and flattened."""
    import datetime as dt
    st = M.stats_by_period(samples(Tables(spark, sf_dir)), ["resource"], 86400, dt.datetime(2024, 1, 1))
    pts = M.series_points(st, "resource")
    series = pts.select(F.concat(F.lit("resource-"), F.col("resource").cast("string")).alias("name"),
                        F.lit("value").alias("unit"), F.col("points").alias("data"))
    out = scratch_dir(spark, "series_json")
    FS.write_json_lines(series, out)
    back = FS.read_json_meta(spark, out, T.StructType([
        T.StructField("name", T.StringType()), T.StructField("unit", T.StringType()),
        T.StructField("data", T.ArrayType(T.StructType([T.StructField("x", T.StringType()),
                                                        T.StructField("y", T.DoubleType())])))]))
    return back.select("name", "unit", F.inline("data"))
