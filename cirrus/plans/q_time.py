"""Queries for SURVEY section 2.7: date and time functions.

"now" is never the wall clock: where a query needs one it is the latest time in
the table, read as a single scalar (one aggregate row, not a join).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cirrus.functions import timefn as TF
from cirrus.operators import metering as M
from cirrus.plans import views as V
from cirrus.plans.q_aggregates import PERIOD_ORIGIN, samples
from cirrus.plans.registry import query
from cirrus.sources.tables import Tables

S = "2.7"


def table_now(df, col: str):
    """Latest time in ``col``, as a scalar subquery: building the query starts no job."""
    return df.agg(F.max(col)).scalar()


@query("ts_parse_multi", section=S, sql="""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5
             WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f')
             WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')
             WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
             WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
             ELSE strftime(o_orderdate, '%d/%m/%Y') END AS text FROM orders)
SELECT o_orderkey, text,
       coalesce(try_strptime(text, '%Y-%m-%dT%H:%M:%S.%f'), try_strptime(text, '%Y-%m-%d %H:%M:%S.%f'),
                try_strptime(text, '%Y-%m-%dT%H:%M:%S'), try_strptime(text, '%Y-%m-%d %H:%M:%S')) AS parsed
FROM t
""")
def ts_parse_multi(spark, sf_dir):
    """Text in one of four layouts parsed as UTC; any other text gives null."""
    o = Tables(spark, sf_dir).orders
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
            .when(k == 1, F.date_format(d, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
            .when(k == 2, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
            .when(k == 3, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.date_format(d, "dd/MM/yyyy")))
    return o.select("o_orderkey", text.alias("text")).withColumn("parsed", TF.parse_multi(F.col("text")))


@query("ts_parse_iso", section=S, sql="""
SELECT event_id, ts - INTERVAL 2 HOUR AS utc_ts FROM events
""")
def ts_parse_iso(spark, sf_dir):
    """ISO 8601 text with a zone parsed strictly (bad or null text raises) and
    normalised to naive UTC."""
    e = Tables(spark, sf_dir).events
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    return e.select("event_id", TF.parse_iso_strict(text).alias("utc_ts"))


@query("ts_format_iso", section=S, sql="""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso_us,
       strftime(make_timestamp(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ')
         AS iso_from_epoch
FROM events
""")
def ts_format_iso(spark, sf_dir):
    """ISO text with 'Z', with and without microseconds, and from epoch seconds."""
    e = Tables(spark, sf_dir).events
    return e.select("event_id", TF.format_iso(F.col("ts")).alias("iso"),
                    TF.format_iso(F.col("ts"), subsecond=True).alias("iso_us"),
                    TF.iso_from_epoch(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("iso_from_epoch"))


@query("ts_day_bounds", section=S, sql="""
SELECT event_id, date_trunc('day', ts) AS day_start, date_trunc('day', ts) + INTERVAL 86399 SECOND AS day_end
FROM events
""")
def ts_day_bounds(spark, sf_dir):
    """Start (00:00:00) and end (23:59:59) of each sample's day, UTC."""
    e = Tables(spark, sf_dir).events
    return e.select("event_id", TF.day_start(F.col("ts")).alias("day_start"), TF.day_end(F.col("ts")).alias("day_end"))


@query("range_default_month", section=S, sql="""
SELECT o_orderkey,
       CASE WHEN day(o_orderdate) < 5
            THEN CAST(date_trunc('month', date_trunc('month', o_orderdate) - INTERVAL 1 DAY) AS DATE)
            ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS range_start,
       CASE WHEN day(o_orderdate) < 5 THEN CAST(date_trunc('month', o_orderdate) - INTERVAL 1 DAY AS DATE)
            ELSE CAST(o_orderdate AS DATE) END AS range_end
FROM orders
""")
def range_default_month(spark, sf_dir):
    """Default report window for a given day: days 1-4 -> the whole previous
    month, otherwise the month to date."""
    o = Tables(spark, sf_dir).orders
    start, end = TF.default_month_range(F.col("o_orderdate"))
    return o.select("o_orderkey", start.alias("range_start"), end.alias("range_end"))


@query("range_check", section=S, sql="""
WITH r AS (SELECT o_orderkey, o_orderdate AS s,
                  o_orderdate + to_days(CAST(floor(o_totalprice / 1000) AS INTEGER) - 150) AS e FROM orders),
     n AS (SELECT max(o_orderdate) - INTERVAL 365 DAY AS today FROM orders)
SELECT o_orderkey, CASE WHEN e < s THEN 'end_before_start' WHEN s > (SELECT today FROM n) THEN 'future'
                        ELSE 'valid' END AS check
FROM r
""")
def range_check(spark, sf_dir):
    """A requested period is valid, ends before it starts, or lies in the future."""
    o = Tables(spark, sf_dir).orders
    today = F.timestamp_add("DAY", F.lit(-365), table_now(o, "o_orderdate"))
    end = F.timestamp_add("DAY", (F.floor(F.col("o_totalprice") / 1000) - 150).cast("int"), F.col("o_orderdate"))
    return o.select("o_orderkey", TF.range_check(F.col("o_orderdate"), end, today).alias("check"))


@query("period_from_range", section=S, sql="""
WITH r AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS secs FROM events GROUP BY user_id)
SELECT user_id, CAST(floor(CASE WHEN floor(secs / 86400) <= 0 THEN 86400 ELSE floor(secs) END / 400) AS BIGINT) AS period
FROM r
""")
def period_from_range(spark, sf_dir):
    """Seconds per chart point for each resource's sample range (400 points;
    under a day counts as a day; integer division)."""
    e = Tables(spark, sf_dir).events
    r = e.groupBy("user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return r.select("user_id", TF.period_from_range(F.col("t0"), F.col("t1")).alias("period"))


@query("uptime_at", section=S, sql=f"""
SELECT server_id, (SELECT max(o_orderdate) FROM orders) - to_seconds(uptime) AS uptime_at FROM ({V.SERVERS_SQL})
""")
def uptime_at(spark, sf_dir):
    """Start time of each server: now - uptime seconds (now = latest order date)."""
    from cirrus.operators.usage import uptime_at as up
    o = Tables(spark, sf_dir).orders
    now = table_now(o, "o_orderdate")
    return V.servers(o).select("server_id", up(F.col("uptime"), now).alias("uptime_at"))


@query("age_predicates", section=S, sql="""
WITH n AS (SELECT max(ts) AS now FROM events)
SELECT event_id,
       (epoch_us((SELECT now FROM n)) - epoch_us(ts)) / 1000000.0 > 7 * 86400 AS older_than_week,
       (epoch_us(ts) - epoch_us((SELECT now FROM n))) / 1000000.0 > -86400 AS within_last_day,
       ts <= (SELECT now FROM n) - INTERVAL 43200 SECOND AS due
FROM events
""")
def age_predicates(spark, sf_dir):
    """Older than a week, newer than a day ago, and 'soon' (due 12 h before now)."""
    e = Tables(spark, sf_dir).events
    now = table_now(e, "ts")
    ts = F.col("ts")
    return e.select("event_id", TF.is_older_than(ts, 7 * 86400, now).alias("older_than_week"),
                    TF.is_newer_than(ts, -86400, now).alias("within_last_day"),
                    TF.is_soon(ts, -43200, now).alias("due"))


@query("delta_seconds", section=S, sql="""
SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1000000.0 AS seconds_into_day FROM events
""")
def delta_seconds(spark, sf_dir):
    """Seconds between two times with microsecond precision."""
    e = Tables(spark, sf_dir).events
    return e.select("event_id", TF.delta_seconds(TF.day_start(F.col("ts")), F.col("ts")).alias("seconds_into_day"))


@query("ts_normalise_utc", section=S, sql="""
SELECT event_id, ts + INTERVAL 8 HOUR AS utc_ts FROM events
""")
def ts_normalise_utc(spark, sf_dir):
    """Zone-aware times (local clock at UTC-08:00) normalised to naive UTC."""
    e = Tables(spark, sf_dir).events
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("-08:00"))
    return e.select("event_id", TF.to_utc_naive(text).alias("utc_ts"))


SERIES_FROM, SERIES_TO = dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 22, 23, 59, 59)
#: Seconds per point: the range over 400 points, a range below a day as one day.
SERIES_PERIOD = max(86400, int((SERIES_TO - SERIES_FROM).total_seconds())) // 400


@query("series_points", section=S, sql=f"""
WITH b AS (SELECT user_id AS resource, value, ts,
                  (epoch_us(ts) - epoch_us(TIMESTAMP '{SERIES_FROM}')) // {SERIES_PERIOD}000000 AS bucket FROM events
           WHERE ts >= TIMESTAMP '{SERIES_FROM}' AND ts <= TIMESTAMP '{SERIES_TO}'),
p AS (SELECT resource, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS x, round(sum(value), 2) / count(*) AS y
      FROM b GROUP BY resource, bucket)
SELECT resource, CAST(count(*) AS INTEGER) AS n_points,
       string_agg(x || '=' || printf('%.6f', y), ';' ORDER BY x) AS points
FROM p GROUP BY resource
""")
def series_points(spark, sf_dir):
    """Chart points per resource of the samples in the chosen period (8 to 22 January):
    seconds per point from the range rule, x = first 19 chars of the last sample time,
    y = average; resources without data there are absent."""
    inside = samples(Tables(spark, sf_dir)).where(F.col("ts").between(
        F.lit(SERIES_FROM).cast("timestamp_ntz"), F.lit(SERIES_TO).cast("timestamp_ntz")))
    st = M.stats_by_period(inside, ["resource"], SERIES_PERIOD, SERIES_FROM)
    pts = M.series_points(st, "resource")
    return pts.select("resource", F.size("points").alias("n_points"), F.array_join(F.transform(
        "points", lambda p: F.concat(p["x"], F.lit("="), F.format_string("%.6f", p["y"]))), ";").alias("points"))
