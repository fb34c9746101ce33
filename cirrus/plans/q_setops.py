"""Queries for SURVEY section 2.6: set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirrus.operators import setops as SE
from cirrus.plans.registry import query
from cirrus.sources.tables import Tables

S = "2.6"


@query("union_typed", section=S, sql="""
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment,
       CAST(NULL AS INTEGER) AS nation, 'customer' AS row_type FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey, 'supplier' FROM supplier
""")
def union_typed(spark, sf_dir):
    """Several row types concatenated by column name, each tagged with its type."""
    t = Tables(spark, sf_dir)
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                          F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                          F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return SE.union_typed({"customer": c, "supplier": s})


@query("union_owned_shared", section=S, sql="""
SELECT c_custkey, c_name, c_mktsegment = 'BUILDING' AS shared FROM customer
WHERE c_nationkey = 7 AND c_mktsegment <> 'BUILDING'
UNION ALL
SELECT c_custkey, c_name, true FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def union_owned_shared(spark, sf_dir):
    """Own non-shared rows plus every shared row, no dedupe (shared = BUILDING)."""
    c = Tables(spark, sf_dir).customer.select("c_custkey", "c_name", "c_nationkey",
                                              (F.col("c_mktsegment") == "BUILDING").alias("shared"))
    # the two parts exclude each other, so one scan with either condition is their union
    return c.where((F.col("c_nationkey") == 7) | F.col("shared")).drop("c_nationkey")


@query("union_if_absent", section=S, sql="""
SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 1
UNION ALL
SELECT c_custkey, c_name FROM customer p WHERE c_mktsegment = 'AUTOMOBILE'
  AND NOT EXISTS (SELECT 1 FROM customer l WHERE l.c_nationkey = 1 AND l.c_custkey = p.c_custkey)
""")
def union_if_absent(spark, sf_dir):
    """Listed rows plus public rows whose id is not already listed."""
    c = Tables(spark, sf_dir).customer
    listed = c.where(F.col("c_nationkey") == 1).select("c_custkey", "c_name")
    public = c.where(F.col("c_mktsegment") == "AUTOMOBILE").select("c_custkey", "c_name")
    return SE.union_if_absent(listed, public, ["c_custkey"])


@query("merge_defaults", section=S, sql="""
WITH a AS (SELECT c_nationkey AS nation, max(c_acctbal) AS v FROM customer
           WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9900 GROUP BY c_nationkey),
     b AS (SELECT s_nationkey AS nation, max(s_acctbal) AS v FROM supplier GROUP BY s_nationkey)
SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.v, b.v) AS value
FROM a FULL OUTER JOIN b ON a.nation = b.nation
""")
def merge_defaults(spark, sf_dir):
    """Two keyed sets merged: the first wins unless its value is null."""
    t = Tables(spark, sf_dir)
    a = t.customer.where((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") > 9900)) \
        .groupBy(F.col("c_nationkey").alias("nation")).agg(F.max("c_acctbal").alias("value"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.max("s_acctbal").alias("value"))
    return SE.merge_defaults(a, b, "nation", "value")


@query("intersect_live", section=S, sql="""
SELECT c_custkey AS id FROM customer
INTERSECT
SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'
""")
def intersect_live(spark, sf_dir):
    """Recorded ids that still exist (distinct)."""
    t = Tables(spark, sf_dir)
    rec = t.customer.select(F.col("c_custkey").alias("id"))
    live = t.orders.where((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")) \
        .select(F.col("o_custkey").alias("id"))
    return rec.intersect(live)


@query("except_groups", section=S, sql="""
WITH want AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O' AND year(o_orderdate) >= 2000),
     cur AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey = 5)
SELECT id, 'add' AS change FROM (SELECT id FROM want EXCEPT SELECT id FROM cur)
UNION ALL
SELECT id, 'remove' FROM (SELECT id FROM cur EXCEPT SELECT id FROM want)
UNION ALL
SELECT count(*), 'union_size' FROM (SELECT id FROM want UNION SELECT id FROM cur)
""")
def except_groups(spark, sf_dir):
    """Wanted minus current ('add'), current minus wanted ('remove'), and the
    size of their union (one 'union_size' row)."""
    t = Tables(spark, sf_dir)
    want = t.orders.where((F.col("o_orderstatus") == "O")
                          & (F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))) \
        .select(F.col("o_custkey").alias("id"))
    cur = t.customer.where(F.col("c_nationkey") == 5).select(F.col("c_custkey").alias("id"))
    return SE.except_both(want, cur, "id")


@query("remove_by_prefix", section=S, sql="""
SELECT page_id, url FROM pages WHERE NOT starts_with(url, 'https://blog.')
""")
def remove_by_prefix(spark, sf_dir):
    """Objects remaining after deleting everything under a prefix."""
    p = Tables(spark, sf_dir).pages.select("page_id", "url")
    return SE.remove_by_prefix(p, "url", "https://blog.")
