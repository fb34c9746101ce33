"""Queries for SURVEY section 2.9: listings, dependency edges, topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirrus.operators import graph as G
from cirrus.plans.registry import query
from cirrus.sources.tables import Tables

S = "2.9"
KEY_RE = r"^[a-z]+://([^?#]*)"


@query("folders_from_paths", section=S, sql=f"""
WITH k AS (SELECT string_split(regexp_extract(url, '{KEY_RE}', 1), '/') AS p FROM pages)
SELECT p[1] || '/' AS prefix, p[2] AS entry, CASE WHEN len(p) > 2 THEN 'folder' ELSE 'object' END AS kind,
       count(*) AS n_keys
FROM k WHERE len(p) > 1 GROUP BY ALL
""")
def folders_from_paths(spark, sf_dir):
    """Delimiter listing under every top-level prefix: direct objects and distinct
    next-level folders with their key counts."""
    p = Tables(spark, sf_dir).pages.select(F.regexp_extract("url", KEY_RE, 1).alias("key"))
    return G.listing_level(p, "key", depth=1)


@query("list_at_prefix", section=S, sql="""
WITH k AS (SELECT substr(url, 13) AS rest, url, octet_length(encode(url)) AS n FROM pages WHERE starts_with(url, 'https://www.'))
SELECT CASE WHEN instr(rest, '/') > 0 THEN substr(url, 1, 12 + instr(rest, '/')) ELSE url END AS entry,
       CASE WHEN instr(rest, '/') > 0 THEN 'folder' ELSE 'object' END AS kind, count(*) AS n_keys, sum(n)::BIGINT AS n_bytes
FROM k GROUP BY ALL
""")
def list_at_prefix(spark, sf_dir):
    """Delimiter listing below a prefix that ends within a name: folders and objects with
    their key counts and bytes."""
    p = Tables(spark, sf_dir).pages.select("url", F.octet_length("url").cast("long").alias("n_bytes"))
    return G.list_prefix(p, "url", "n_bytes", "https://www.")


@query("folder_totals_all_depths", section=S, sql=f"""
WITH k AS (SELECT string_split(regexp_extract(url, '{KEY_RE}', 1), '/') AS p, octet_length(encode(url)) AS n FROM pages),
a AS (SELECT array_to_string(p[1:d], '/') || '/' AS folder, d AS depth, n, d = len(p) - 1 AS direct
      FROM k, LATERAL (SELECT unnest(range(1, len(k.p))) AS d))
SELECT folder, depth, count(*) AS n_keys, sum(n)::BIGINT AS n_bytes, count(*) FILTER (WHERE direct) AS n_direct
FROM a GROUP BY folder, depth
""")
def folder_totals_all_depths(spark, sf_dir):
    """Keys and bytes below every folder at every depth, in one pass up the path tree."""
    p = Tables(spark, sf_dir).pages.select(F.regexp_extract("url", KEY_RE, 1).alias("key"), F.octet_length("url").cast("long").alias("n_bytes"))
    return G.folder_totals(p, "key", "n_bytes")


@query("edges_dependency", section=S, sql="""
WITH n AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, conv_id, turn FROM conversations),
e AS (SELECT n.id AS source, CAST(n.conv_id AS VARCHAR) || ':' || CAST(n.turn + d AS VARCHAR) AS target
      FROM n, (SELECT 1 AS d UNION ALL SELECT 2) ds)
SELECT DISTINCT source, target FROM e WHERE target IN (SELECT id FROM n)
""")
def edges_dependency(spark, sf_dir):
    """Each turn is required by the next two turns of its conversation; edges to
    turns that do not exist are dropped, duplicates removed."""
    c = Tables(spark, sf_dir).conversations
    tid = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    nodes = c.select(tid(F.col("turn")).alias("id"),
                     F.array(tid(F.col("turn") + 1), tid(F.col("turn") + 2)).alias("required_by"))
    return G.dependency_edges(nodes, "id", "required_by")


@query("topology_assemble", section=S, sql="""
SELECT 'server-' || CAST(c_custkey AS VARCHAR) AS id, c_name AS label,
       'network-' || CAST(c_nationkey AS VARCHAR) AS parent_id, 'server' AS kind FROM customer
UNION ALL SELECT 'network-' || CAST(n_nationkey AS VARCHAR), n_name, 'router-' || CAST(n_regionkey AS VARCHAR), 'network'
FROM nation
UNION ALL SELECT 'subnet-' || CAST(n_nationkey AS VARCHAR), n_name || '-subnet', 'network-' || CAST(n_nationkey AS VARCHAR),
       'subnet' FROM nation
UNION ALL SELECT 'port-' || CAST(s_suppkey AS VARCHAR), s_name, 'network-' || CAST(s_nationkey AS VARCHAR), 'port'
FROM supplier
UNION ALL SELECT 'router-' || CAST(r_regionkey AS VARCHAR), r_name, NULL, 'router' FROM region
""")
def topology_assemble(spark, sf_dir):
    """Node table of servers, networks with subnets, ports and routers, each with
    its parent (the edge), tagged by kind."""
    t = Tables(spark, sf_dir)
    servers = t.customer.select(G.id_text("server-", F.col("c_custkey")).alias("id"), F.col("c_name").alias("label"),
                                G.id_text("network-", F.col("c_nationkey")).alias("parent_id"))
    networks = t.nation.select(G.id_text("network-", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("label"),
                               G.id_text("router-", F.col("n_regionkey")).alias("parent_id"))
    subnets = t.nation.select(G.id_text("subnet-", F.col("n_nationkey")).alias("id"),
                              F.concat("n_name", F.lit("-subnet")).alias("label"),
                              G.id_text("network-", F.col("n_nationkey")).alias("parent_id"))
    ports = t.supplier.select(G.id_text("port-", F.col("s_suppkey")).alias("id"), F.col("s_name").alias("label"),
                              G.id_text("network-", F.col("s_nationkey")).alias("parent_id"))
    routers = t.region.select(G.id_text("router-", F.col("r_regionkey")).alias("id"), F.col("r_name").alias("label"),
                              F.lit(None).cast("string").alias("parent_id"))
    return G.assemble({"server": servers, "network": networks, "subnet": subnets, "port": ports, "router": routers})


@query("devices_by_network", section=S, sql="""
WITH m AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS network FROM lineitem GROUP BY l_orderkey),
d AS (SELECT m.network, CASE WHEN o.o_orderstatus = 'F' THEN 'router' ELSE 'server' END AS kind, o.o_orderkey AS device
      FROM m JOIN orders o ON o.o_orderkey = m.l_orderkey)
SELECT network, kind, device, count(*) OVER (PARTITION BY network) AS n_devices FROM d
""")
def devices_by_network(spark, sf_dir):
    """Devices (orders; finished ones are routers) under their main network
    (lowest-position port), routers first, then servers."""
    t = Tables(spark, sf_dir)
    main = G.main_network(t.lineitem, "l_orderkey", "l_partkey", "l_linenumber") \
        .withColumnRenamed("l_partkey", "network")
    dev = main.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey").select(
        "network", F.when(F.col("o_orderstatus") == "F", "router").otherwise("server").alias("kind"),
        F.col("l_orderkey").alias("device"))
    return G.devices_by_network(dev, "network", ["router", "server"])
