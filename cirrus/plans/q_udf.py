"""Queries for SURVEY section 2.11: user-defined functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirrus.operators import aggregates as AG
from cirrus.operators import udf as UD
from cirrus.plans.registry import query
from cirrus.sources.tables import Tables

S = "2.11"


@query("udf_column_transform", section=S, sql="""
SELECT l_orderkey, l_linenumber,
       upper(l_returnflag) || '-' || lower(l_linestatus) AS flags,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
FROM lineitem
""")
def udf_column_transform(spark, sf_dir):
    """A callable as a column and a chain of filter functions applied in order."""
    li = Tables(spark, sf_dir).lineitem
    flags = UD.chain(lambda c: F.concat(F.upper(c), F.lit("-"), F.lower(F.col("l_linestatus"))))
    charge = UD.chain(lambda c: c * (1 - F.col("l_discount")), lambda c: c * (1 + F.col("l_tax")))
    return li.select("l_orderkey", "l_linenumber", flags(F.col("l_returnflag")).alias("flags"),
                     charge(F.col("l_extendedprice")).alias("charge"))


@query("udf_filter_action", section=S, sql="""
SELECT p_partkey, p_name, p_type FROM part WHERE p_type = 'PROMO' AND p_retailprice > 950
""")
def udf_filter_action(spark, sf_dir):
    """User filter methods per table type; the 'promo' type's method is applied."""
    actions = {
        "promo": lambda df: df.where((F.col("p_type") == "PROMO") & (F.col("p_retailprice") > 950)),
        "small": lambda df: df.where(F.col("p_size") < 5),
    }
    p = Tables(spark, sf_dir).part
    return UD.apply_filter_action(p, actions, "promo").select("p_partkey", "p_name", "p_type")


@query("udaf_summary_registry", section=S, sql="""
SELECT l_returnflag, round(sum(l_quantity), 2) AS qty_sum, round(sum(l_quantity), 2) / count(l_quantity) AS qty_average,
       max(l_quantity) - min(l_quantity) AS qty_spread, count(l_quantity) AS qty_count
FROM lineitem GROUP BY l_returnflag
""")
def udaf_summary_registry(spark, sf_dir):
    """Named summary methods, extended with user entries ('spread', 'count');
    an unknown name raises ValueError."""
    AG.register_summary("spread", lambda c: F.max(c) - F.min(c))
    AG.register_summary("count", F.count)
    li = Tables(spark, sf_dir).lineitem
    q = F.col("l_quantity")
    return li.groupBy("l_returnflag").agg(
        AG.summary_expr("sum_exact", q).alias("qty_sum"), AG.summary_expr("average_exact", q).alias("qty_average"),
        AG.summary_expr("spread", q).alias("qty_spread"), AG.summary_expr("count", q).alias("qty_count"))


@query("udtf_ordered_program", section=S, sql="""
WITH g AS (SELECT user_id, ts, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
l AS (SELECT user_id, session, max(epoch_us(ts)) - min(epoch_us(ts)) AS long FROM s GROUP BY user_id, session)
SELECT user_id, count(*) AS samples, min(ts) AS first_sample, max(ts) AS last_sample, coalesce(max(gap), 0) AS longest_gap_us,
       max(session)::BIGINT + 1 AS sessions, (SELECT max(long) FROM l WHERE l.user_id = s.user_id) AS longest_session_us
FROM s GROUP BY user_id
""")
def udtf_ordered_program(spark, sf_dir):
    """A user reducer that needs each resource's samples in order: gaps between
    samples, sessions (an hour of silence ends one) and the longest of both. A hot
    resource is split by time and its parts merged by the program."""
    from cirrus.operators import programs as P
    e = Tables(spark, sf_dir).events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return P.reduce_ordered(e, ["user_id"], ["us", "event_id"], P.Gaps("us", 3600))


@query("udtf_external_program", section=S, sql="""
SELECT lower(substring(line, 1, 1)) AS key, count(*) AS n_lines
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE length(line) >= 20 GROUP BY lower(substring(line, 1, 1))
""")
def udtf_external_program(spark, sf_dir):
    """A user mapper/reducer program over a folder: the documents are written as
    text (the input folder), the mapper (pandas, per Arrow batch, with the extra
    argument min_length=20) emits (first letter, 1) per long line, the
    associative reducer (sum) runs as a combiner and per key, and the result is
    written to the output folder and read back."""
    from cirrus.session import scratch_dir
    from cirrus.sources.files import write_text
    src, out = scratch_dir(spark, "program_in"), scratch_dir(spark, "program_out")
    write_text(Tables(spark, sf_dir).documents, "text", src)
    return UD.run_text_program(spark, src, out, UD.initial_mapper, "key string, n_lines long", "key", "n_lines",
                               "sum", args={"min_length": 20})
