"""Queries for SURVEY section 2.5: sorts, paging, tail and per-group picks.

Full sorts are range-partitioned by Spark (sampled bounds) and sorted per
partition; top-k and paging use ``limit`` after ``orderBy`` (TakeOrderedAndProject,
a per-partition top-k then a merge); per-group "last n" uses a window whose
``row_number() <= n`` filter Spark pushes below the shuffle as a partial
WindowGroupLimit, so a huge group never reaches one task whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cirrus.functions import display as D
from cirrus.operators import jobs as J
from cirrus.operators import page_index as PI
from cirrus.operators import sorting as SO
from cirrus.operators import table as TB
from cirrus.plans import views as V
from cirrus.plans.registry import query
from cirrus.session import scratch_dir
from cirrus.sources.tables import Tables

S = "2.5"


@query("sort_multi_key", section=S, sql=f"""
SELECT flavor_id, vcpus, ram, disk FROM ({V.FLAVORS_SQL}) ORDER BY vcpus, ram, disk, flavor_id
""")
def sort_multi_key(spark, sf_dir):
    """Flavors sorted by (vcpus, ram, disk), id as the final tiebreak."""
    f = V.flavors(Tables(spark, sf_dir).part)
    return f.select("flavor_id", "vcpus", "ram", "disk").orderBy("vcpus", "ram", "disk", "flavor_id")


@query("sort_configured", section=S, sql="""
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey
""")
def sort_configured(spark, sf_dir):
    """Sort by a configured key and direction (here: price, descending)."""
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_retailprice")
    return SO.sort_configured(p, {"key": "p_retailprice", "reverse": True}, tiebreak="p_partkey")


@query("sort_newest_first", section=S, sql="""
SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC
""")
def sort_newest_first(spark, sf_dir):
    """Newest first (date descending, id descending on ties)."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderdate")
    return o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())


@query("sort_flag_first", section=S, sql="""
SELECT o_orderkey, o_orderstatus = 'O' AS external FROM orders ORDER BY external DESC, o_orderkey
""")
def sort_flag_first(spark, sf_dir):
    """Flagged rows (open orders = external networks) first; ties keep list order."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", (F.col("o_orderstatus") == "O").alias("external"))
    return o.orderBy(F.col("external").desc(), "o_orderkey")


@query("sort_by_name", section=S, sql="""
SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey
""")
def sort_by_name(spark, sf_dir):
    """Choice lists sorted by name (id on ties)."""
    return Tables(spark, sf_dir).supplier.select("s_suppkey", "s_name").orderBy("s_name", "s_suppkey")


SIZE_TEXT_SQL = """CASE
  WHEN n_chars * 1000 < 1024 THEN CAST(CAST(floor(n_chars * 1000) AS BIGINT) AS VARCHAR)
  WHEN n_chars * 1000 < 1048576 THEN printf('%.1f', round(n_chars * 1000 / 1024.0, 1)) || ' KB'
  WHEN n_chars * 1000 < 1073741824 THEN printf('%.1f', round(n_chars * 1000 / 1048576.0, 1)) || ' MB'
  ELSE printf('%.1f', round(n_chars * 1000 / 1073741824.0, 1)) || ' GB' END"""


@query("sort_by_size_text", section=S, sql=f"""
WITH d AS (SELECT doc_id, {SIZE_TEXT_SQL} AS size_text FROM documents),
m AS (SELECT doc_id, size_text,
             regexp_extract(size_text, '([0-9.,]+)\\s*(byte|B|KB|MB|GB|TB|PB)+', 1, 'i') AS num,
             upper(regexp_extract(size_text, '([0-9.,]+)\\s*(byte|B|KB|MB|GB|TB|PB)+', 2, 'i')) AS unit
      FROM d)
SELECT doc_id, size_text,
       CASE WHEN unit <> '' THEN
              CAST(nullif(regexp_extract(num, '^[0-9]*\\.?[0-9]*', 0), '') AS DOUBLE)
              * pow(1024, CASE unit WHEN 'BYTE' THEN 0 WHEN 'B' THEN 0 WHEN 'KB' THEN 1 WHEN 'MB' THEN 2
                                    WHEN 'GB' THEN 3 WHEN 'TB' THEN 4 ELSE 5 END)
            ELSE CAST(nullif(regexp_extract(size_text, '^\\s*[+-]?[0-9]+', 0), '') AS DOUBLE) END AS size_bytes
FROM m ORDER BY size_bytes, doc_id
""")
def sort_by_size_text(spark, sf_dir):
    """Sort text such as '12.5 KB' by its byte value; unit-less text by its
    leading integer (parseFloat stops at a comma)."""
    d = Tables(spark, sf_dir).documents.select(
        "doc_id", D.size_format(F.col("n_chars") * 1000).alias("size_text"))
    return d.withColumn("size_bytes", SO.size_text_bytes(F.col("size_text"))).orderBy("size_bytes", "doc_id")


IP_SQL = ("CAST(s_nationkey AS VARCHAR) || '.' || CAST(s_suppkey % 256 AS VARCHAR) || '.' "
          "|| CAST((s_suppkey * 7) % 256 AS VARCHAR) || '.' || CAST(s_suppkey % 10 AS VARCHAR)")


@query("sort_by_ip", section=S, sql=f"""
SELECT s_suppkey, {IP_SQL} AS ip FROM supplier
ORDER BY s_nationkey, s_suppkey % 256, (s_suppkey * 7) % 256, s_suppkey % 10, s_suppkey
""")
def sort_by_ip(spark, sf_dir):
    """Dotted addresses sorted numerically octet by octet."""
    s = Tables(spark, sf_dir).supplier
    ip = F.concat_ws(".", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 256).cast("string"),
                     ((F.col("s_suppkey") * 7) % 256).cast("string"), (F.col("s_suppkey") % 10).cast("string"))
    return SO.sort_by_ip(s.select("s_suppkey", ip.alias("ip")), "ip", tiebreak="s_suppkey")


@query("sort_total_order", section=S, sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
""")
def sort_total_order(spark, sf_dir):
    """Total-order sort by price: sampled range partitions, sorted within each."""
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return J.total_order_sort(li, "l_extendedprice", n)


@query("sort_array_field", section=S, sql="""
SELECT l.l_orderkey, string_agg(p.p_name, ', ' ORDER BY p.p_size, p.p_name) AS parts_by_size
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY l.l_orderkey
""")
def sort_array_field(spark, sf_dir):
    """A nested list sorted by a field (part size, then name) and joined as text."""
    from cirrus.operators.joins import lookup
    t = Tables(spark, sf_dir)
    j = lookup(t.lineitem.select("l_orderkey", "l_partkey"),
               t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size"), "l_partkey", how="inner")
    from cirrus.operators.enrich import bounded, collect_list
    nested = bounded(j, "l_orderkey").groupBy("l_orderkey").agg(collect_list(F.struct("p_size", "p_name")).alias("parts"))
    return nested.select("l_orderkey", F.array_join(SO.sort_array_by(F.col("parts"), ["p_size", "p_name"],
                                                                        struct_fields=["p_size", "p_name"])["p_name"],
                                                    ", ").alias("parts_by_size"))


@query("page_marker", section=S, sql="""
WITH f AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 21),
r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM f)
SELECT o_orderkey, o_custkey, n > 20 AS has_more,
       CASE WHEN n > 20 THEN max(o_orderkey) FILTER (WHERE rn <= 20) OVER () END AS next_marker
FROM r WHERE rn <= 20
""")
def page_marker(spark, sf_dir):
    """Keyset page after marker 100, page size 20; has_more and next marker."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey")
    return TB.page_after_marker(o, "o_orderkey", 100, 20)


@query("page_previous", section=S, sql="""
WITH f AS (SELECT o_orderdate, o_orderkey, o_custkey FROM orders
           WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-06-01 00:00:00', 1000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21),
r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, count(*) OVER () > 20 AS has_more FROM f)
SELECT o_orderdate, o_orderkey, o_custkey, has_more FROM r WHERE rn <= 20
""")
def page_previous(spark, sf_dir):
    """The page before a marker in the order of two keys (date, then id)."""
    import datetime as dt
    o = Tables(spark, sf_dir).orders.select("o_orderdate", "o_orderkey", "o_custkey")
    return TB.page_around_marker(o, ["o_orderdate", "o_orderkey"], [dt.datetime(1996, 6, 1), 1000], 20, backward=True)


@query("page_indexed", section=S, sql="""
WITH r AS (SELECT o_orderdate, o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders)
SELECT * FROM r WHERE position BETWEEN 50 * 20 AND 51 * 20 - 1
""")
def page_indexed(spark, sf_dir):
    """The 51st page in the order of two keys, by a sparse index of key ranges."""
    orders = Tables(spark, sf_dir).orders.select("o_orderdate", "o_orderkey", "o_custkey")
    index = PI.build(orders, ["o_orderdate", "o_orderkey"], scratch_dir(spark, "pages"), ranges=32)
    return index.numbered(50, 20)


@query("page_indexed_previous", section=S, sql="""
WITH f AS (SELECT o_orderdate, o_orderkey, o_custkey FROM orders
           WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-06-01 00:00:00', 1000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21),
r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, count(*) OVER () > 20 AS has_more FROM f)
SELECT o_orderdate, o_orderkey, o_custkey, has_more FROM r WHERE rn <= 20
""")
def page_indexed_previous(spark, sf_dir):
    """The page before a marker, by the same index."""
    import datetime as dt
    orders = Tables(spark, sf_dir).orders.select("o_orderdate", "o_orderkey", "o_custkey")
    index = PI.build(orders, ["o_orderdate", "o_orderkey"], scratch_dir(spark, "pages"), ranges=32)
    return index.around([dt.datetime(1996, 6, 1), 1000], 20, backward=True)


@query("tail_n", section=S, sql="""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM conversations)
SELECT conv_id, turn, line_no, line FROM l
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, line_no DESC) <= 35
""")
def tail_n(spark, sf_dir):
    """Last 35 lines of each conversation log (lines of all turns, in order)."""
    c = Tables(spark, sf_dir).conversations
    lines = c.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line")) \
        .select("conv_id", "turn", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    return SO.last_n(lines, ["conv_id"], [F.col("turn").desc(), F.col("line_no").desc()], 35)


@query("pick_main_edge", section=S, sql="""
WITH m AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS net FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, coalesce(m.net, (SELECT min(p_partkey) FROM part)) AS main_network
FROM orders o LEFT JOIN m ON m.l_orderkey = o.o_orderkey
""")
def pick_main_edge(spark, sf_dir):
    """A device's main network: the attached one with the lowest position
    (a partial aggregate); a device without ports goes to the first
    network of the list."""
    t = Tables(spark, sf_dir)
    first_net = t.part.agg(F.min("p_partkey")).scalar()
    main = SO.first_by_position(t.lineitem, "l_orderkey", "l_linenumber", "l_partkey", "net")
    j = t.orders.select("o_orderkey").join(main, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.coalesce("net", first_net).alias("main_network"))
