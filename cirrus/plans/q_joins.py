"""Queries for SURVEY section 2.3: enrichment joins, semi/anti joins, diffs, lookups.

Dimension sides go through ``lookup`` (broadcast only behind a bounded row probe);
fact-to-fact joins (orders/lineitem) are left to sort-merge with AQE skew splitting.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cirrus.functions import display as D
from cirrus.operators import enrich as EN
from cirrus.operators.joins import anti_join, label_or_id, lookup, semi_join
from cirrus.plans import views as V
from cirrus.plans.registry import query
from cirrus.sources.tables import Tables

S = "2.3"


@query("join_two_dims", section=S, sql="""
SELECT l.l_orderkey, l.l_linenumber, f.flavor_name, f.vcpus,
       coalesce(s.s_name, CAST(l.l_suppkey AS VARCHAR)) AS image_name
FROM lineitem l
LEFT JOIN (SELECT p_partkey AS flavor_id, p_name AS flavor_name, CAST(1 + p_size % 8 AS INTEGER) AS vcpus
           FROM part) f ON f.flavor_id = l.l_partkey
LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
""")
def join_two_dims(spark, sf_dir):
    """Servers (line items) enriched with flavor and image; a missing image keeps the id."""
    t = Tables(spark, sf_dir)
    fl = V.flavors(t.part).select("flavor_id", "flavor_name", "vcpus")
    j = lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), fl,
               F.col("l_partkey") == F.col("flavor_id"))
    j = lookup(j, t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select("l_orderkey", "l_linenumber", "flavor_name", "vcpus",
                    F.coalesce(F.col("s_name"), F.col("l_suppkey").cast("string")).alias("image_name"))


@query("join_dim_and_owner", section=S, sql=f"""
SELECT s.server_id, s.vcpus, c.c_name AS tenant_name, n.n_name AS domain_name
FROM ({V.SERVERS_SQL}) s
LEFT JOIN customer c ON c.c_custkey = s.tenant_id
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
""")
def join_dim_and_owner(spark, sf_dir):
    """Server + owner project name (null when unknown) + the project's domain."""
    t = Tables(spark, sf_dir)
    s = V.servers(t.orders).select("server_id", "vcpus", "tenant_id")
    c = t.customer.select(F.col("c_custkey").alias("tenant_id"), F.col("c_name").alias("tenant_name"),
                          "c_nationkey")
    j = s.join(c, "tenant_id", "left")          # fact-to-fact sized: sort-merge / AQE decides
    j = lookup(j, t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("domain_name")),
               "c_nationkey")
    return j.select("server_id", "vcpus", "tenant_name", "domain_name")


@query("join_owner_name", section=S, sql="""
SELECT c.c_custkey, c.c_name, n.n_name AS owner_name
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
""")
def join_owner_name(spark, sf_dir):
    """Attach the owner's (project's) name; unknown owners keep a null name."""
    t = Tables(spark, sf_dir)
    nat = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("owner_name"))
    return lookup(t.customer.select("c_custkey", "c_name", "c_nationkey"), nat, "c_nationkey") \
        .select("c_custkey", "c_name", "owner_name")


@query("join_exploded_array", section=S, sql="""
SELECT l.l_orderkey,
       string_agg('Attached to ' || coalesce(p.p_name, CAST(l.l_partkey AS VARCHAR)) || ' on /dev/vd'
                  || chr(96 + l.l_linenumber), ', '
                  ORDER BY l.l_linenumber, 'Attached to ' || coalesce(p.p_name, CAST(l.l_partkey AS VARCHAR))
                  || ' on /dev/vd' || chr(96 + l.l_linenumber)) AS attachments
FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey
GROUP BY l.l_orderkey
""")
def join_exploded_array(spark, sf_dir):
    """Volume attachments as one text per volume (order): 'Attached to X on dev'
    items in position order (ties by text) joined by ', '; volumes without attachments are absent.
    The per-volume list is bounded by the attachments a volume can have."""
    t = Tables(spark, sf_dir)
    att = lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"),
                 t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    item = F.concat(F.lit("Attached to "), F.coalesce(F.col("p_name"), F.col("l_partkey").cast("string")),
                    F.lit(" on /dev/vd"), F.expr("chr(96 + l_linenumber)"))
    return EN.ordered_text(att.withColumn("item", item), "l_orderkey", "l_linenumber", "item", ", ") \
        .withColumnRenamed("text", "attachments")


@query("join_expand_id_array", section=S, sql=f"""
SELECT l.l_orderkey,
       string_agg(coalesce(p.p_name, 'null'), '|' ORDER BY l.l_linenumber, l.l_partkey) AS parts,
       CAST(count(*) AS INTEGER) AS n_ids,
       CAST(count(p.p_name) AS INTEGER) AS n_found
FROM lineitem l LEFT JOIN part p ON p.p_partkey = {V.PART_KEY_SQL}
GROUP BY l.l_orderkey
""")
def join_expand_id_array(spark, sf_dir):
    """An ordered id array per order replaced by the records it names; unknown ids
    (a seventh line's) become null elements, order kept."""
    t = Tables(spark, sf_dir)
    ids = EN.ordered_array(t.lineitem.select("l_orderkey", "l_linenumber", V.part_key().alias("part_id")),
                           "l_orderkey", "l_linenumber", "part_id", "part_ids")
    catalogue = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    rec = EN.expand_id_array(ids, "l_orderkey", "part_ids", catalogue, "id", "parts_rec")
    return rec.select(
        "l_orderkey",
        F.array_join(F.col("parts_rec.name"), "|", "null").alias("parts"),
        F.size("parts_rec").alias("n_ids"),
        F.size(F.filter("parts_rec", lambda r: r["name"].isNotNull())).alias("n_found"))


@query("join_parent_policy", section=S, sql="""
SELECT o.o_orderkey, c.c_custkey AS policy_id, c.c_name AS policy_name
FROM orders o LEFT JOIN customer c ON c.c_custkey = CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE o.o_custkey END
""")
def join_parent_policy(spark, sf_dir):
    """Rule (order) -> its policy (a customer), null when it has none (pending orders)."""
    t = Tables(spark, sf_dir)
    pol = t.customer.select(F.col("c_custkey").alias("policy_id"), F.col("c_name").alias("policy_name"))
    rules = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("policy"))
    return rules.join(pol, F.col("policy") == F.col("policy_id"), "left") \
        .select("o_orderkey", "policy_id", "policy_name")


@query("join_fip_chain", section=S, sql=f"""
SELECT l.l_orderkey, l.l_linenumber, c.c_name AS server_name,
       coalesce(n.n_name, CAST({V.POOL_KEY_SQL} AS VARCHAR)) AS pool_name
FROM lineitem l
LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
LEFT JOIN nation n ON n.n_nationkey = {V.POOL_KEY_SQL}
""")
def join_fip_chain(spark, sf_dir):
    """Floating IP (line) -> port (order) -> server name (customer); pool name
    (nation of the supplier) falls back to the pool id."""
    t = Tables(spark, sf_dir)
    # Resolve port -> server name on the smaller side first, so the line items
    # (the largest table) are shuffled once, by order key, not twice.
    ports = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(
        t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("server_name")),
        "o_custkey", "left").select("l_orderkey", "server_name")
    j = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").join(ports, "l_orderkey", "left")
    j = lookup(j, t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), V.pool_key().alias("pool")), "l_suppkey")
    j = lookup(j, t.nation.select(F.col("n_nationkey").alias("pool"), "n_name"), "pool")
    return j.select("l_orderkey", "l_linenumber", "server_name",
                    F.coalesce(F.col("n_name"), F.col("pool").cast("string")).alias("pool_name"))


IP_SQL = ("'10.' || CAST(l.l_suppkey % 256 AS VARCHAR) || '.' || CAST(l.l_partkey % 256 AS VARCHAR) || '.' "
          "|| CAST(l.l_linenumber AS VARCHAR)")


def _ip():
    return F.concat(F.lit("10."), (F.col("l_suppkey") % 256).cast("string"), F.lit("."),
                    (F.col("l_partkey") % 256).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))


@query("join_address_targets", section=S, sql=f"""
SELECT CAST(o.o_orderkey AS VARCHAR) || '_' || {IP_SQL} AS target_id,
       'server-' || CAST(o.o_orderkey AS VARCHAR) || ': ' || {IP_SQL} AS target_name
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE NOT starts_with(CASE WHEN o.o_orderstatus = 'P' THEN 'network:dhcp' ELSE 'compute:server' END, 'network:')
""")
def join_address_targets(spark, sf_dir):
    """One target per port address; ports owned by 'network:*' are skipped."""
    t = Tables(spark, sf_dir)
    ports = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "network:dhcp")
                            .otherwise("compute:server").alias("device_owner"))
    ports = ports.where(~F.col("device_owner").startswith("network:"))
    addr = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_partkey", "l_linenumber")
    j = ports.join(addr, "o_orderkey")
    return j.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("_"), _ip()).alias("target_id"),
                    F.concat(F.lit("server-"), F.col("o_orderkey").cast("string"), F.lit(": "), _ip())
                     .alias("target_name"))


@query("join_parent_snapshot", section=S, sql=f"""
SELECT l.l_orderkey, l.l_linenumber,
       coalesce('vol-' || CAST(v.o_orderkey AS VARCHAR), CAST({V.VOLUME_KEY_SQL} AS VARCHAR)) AS volume_name
FROM lineitem l LEFT JOIN orders v ON v.o_orderkey = {V.VOLUME_KEY_SQL}
""")
def join_parent_snapshot(spark, sf_dir):
    """Snapshot (line) -> its volume (order); the volume of a seventh line is gone, so
    the volume id is shown instead of its name."""
    t = Tables(spark, sf_dir)
    vols = t.orders.select(
        F.col("o_orderkey").alias("vid"), F.concat(F.lit("vol-"), F.col("o_orderkey").cast("string")).alias("vname"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", V.volume_key().alias("volume"))
    return lines.join(vols, F.col("volume") == F.col("vid"), "left").select(
        "l_orderkey", "l_linenumber", F.coalesce(F.col("vname"), F.col("volume").cast("string")).alias("volume_name"))


@query("join_labels_fallback", section=S, sql=f"""
SELECT l.l_orderkey, l.l_linenumber,
       coalesce(p.p_name, CAST({V.PART_KEY_SQL} AS VARCHAR)) AS pool_label,
       coalesce(s.s_name, CAST(l.l_suppkey AS VARCHAR)) AS member_label,
       CASE WHEN s.s_nationkey IS NULL THEN NULL ELSE coalesce(n.n_name, CAST({V.POOL_KEY_SQL} AS VARCHAR)) END
         AS region_label
FROM lineitem l
LEFT JOIN part p ON p.p_partkey = {V.PART_KEY_SQL}
LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
LEFT JOIN nation n ON n.n_nationkey = {V.POOL_KEY_SQL}
""")
def join_labels_fallback(spark, sf_dir):
    """Several id -> label lookups; a failed lookup shows the id, a null id stays null."""
    t = Tables(spark, sf_dir)
    j = lookup(t.lineitem.select("l_orderkey", "l_linenumber", V.part_key().alias("part_id"), "l_suppkey"),
               t.part.select(F.col("p_partkey").alias("part_id"), "p_name"), "part_id")
    j = lookup(j, t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name", V.pool_key().alias("pool")), "l_suppkey")
    j = lookup(j, t.nation.select(F.col("n_nationkey").alias("pool"), "n_name"), "pool")
    return j.select("l_orderkey", "l_linenumber",
                    label_or_id(F.col("p_name"), F.col("part_id")).alias("pool_label"),
                    label_or_id(F.col("s_name"), F.col("l_suppkey")).alias("member_label"),
                    label_or_id(F.col("n_name"), F.col("pool")).alias("region_label"))


@query("join_binding_last_wins", section=S, sql="""
SELECT c.c_custkey, b.o_orderpriority AS bound_tenant
FROM customer c LEFT JOIN (
  SELECT o_custkey, o_orderpriority FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) b
ON b.o_custkey = c.c_custkey
""")
def join_binding_last_wins(spark, sf_dir):
    """Profile -> bindings -> tenant: the last binding in (date, id) order wins.
    ``max_by`` is a partial aggregate, so a profile with a huge binding list
    still ships one row per map task."""
    t = Tables(spark, sf_dir)
    last = t.orders.groupBy("o_custkey").agg(
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("bound_tenant"))
    return t.customer.select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left") \
        .select("c_custkey", "bound_tenant")


@query("join_group_names", section=S, sql="""
WITH r AS (SELECT c_custkey,
                  CASE WHEN c_mktsegment <> 'HOUSEHOLD'
                       THEN 'grp-' || lpad(CAST(c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END AS VARCHAR), 12, '0')
                  END AS remote_group_id
           FROM customer),
     g AS (SELECT 'grp-' || lpad(CAST(n_nationkey AS VARCHAR), 12, '0') AS gid, n_name FROM nation)
SELECT r.c_custkey,
       CASE WHEN r.remote_group_id IS NULL THEN '' ELSE coalesce(g.n_name, substring(r.remote_group_id, 1, 13))
       END AS remote_group
FROM r LEFT JOIN g ON g.gid = r.remote_group_id
""")
def join_group_names(spark, sf_dir):
    """Rule -> remote group name; unknown id shows its first 13 chars; no group -> ''."""
    t = Tables(spark, sf_dir)
    gid = lambda c: F.concat(F.lit("grp-"), F.lpad(c.cast("string"), 12, "0"))
    rules = t.customer.select("c_custkey", F.when(F.col("c_mktsegment") != "HOUSEHOLD", gid(
        F.col("c_nationkey") + F.when(F.col("c_custkey") % 10 == 0, 100).otherwise(0))).alias("remote_group_id"))
    groups = t.nation.select(gid(F.col("n_nationkey")).alias("remote_group_id"),
                                                              "n_name")
    j = lookup(rules, groups, "remote_group_id")
    return j.select("c_custkey", F.when(F.col("remote_group_id").isNull(), F.lit("")).otherwise(
        F.coalesce(F.col("n_name"), F.substring("remote_group_id", 1, 13))).alias("remote_group"))


@query("join_template_3key", section=S, sql="""
WITH tpl AS (SELECT p_size AS from_port, p_size AS to_port, lower(p_type) AS protocol, min(p_name) AS tname
             FROM part GROUP BY p_size, lower(p_type)),
     ports AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS from_port,
                      CAST(l_quantity AS INTEGER) + CASE WHEN l_linenumber > 5 THEN 10 ELSE 0 END AS to_port,
                      CASE l_returnflag WHEN 'A' THEN 'economy' WHEN 'N' THEN 'standard' ELSE 'promo' END AS protocol
               FROM lineitem)
SELECT p.l_orderkey, p.l_linenumber,
       CAST(p.from_port AS VARCHAR) || coalesce(' (' || a.tname || ')', '')
         || CASE WHEN p.from_port = p.to_port THEN ''
                 ELSE ' - ' || CAST(p.to_port AS VARCHAR) || coalesce(' (' || b.tname || ')', '') END AS port_label
FROM ports p
LEFT JOIN tpl a ON a.from_port = p.from_port AND a.to_port = p.from_port AND a.protocol = p.protocol
LEFT JOIN tpl b ON b.from_port = p.to_port AND b.to_port = p.to_port AND b.protocol = p.protocol
""")
def join_template_3key(spark, sf_dir):
    """Ports with the name of the template for (port, port, protocol) in brackets; of
    a range each end is looked up by itself: '22 (SSH) - 80 (HTTP)'."""
    t = Tables(spark, sf_dir)
    tpl = t.part.groupBy(F.col("p_size").alias("port"), F.lower("p_type").alias("protocol")).agg(F.min("p_name").alias("tname"))
    q = F.col("l_quantity").cast("int")
    ports = t.lineitem.select(
        "l_orderkey", "l_linenumber", q.alias("from_port"),
        (q + F.when(F.col("l_linenumber") > 5, 10).otherwise(0)).alias("to_port"),
        F.when(F.col("l_returnflag") == "A", "economy").when(F.col("l_returnflag") == "N", "standard")
         .otherwise("promo").alias("protocol"))
    first = tpl.select(F.col("port").alias("from_port"), "protocol", F.col("tname").alias("from_name"))
    last = tpl.select(F.col("port").alias("to_port"), "protocol", F.col("tname").alias("to_name"))
    j = lookup(lookup(ports, first, ["from_port", "protocol"]), last, ["to_port", "protocol"])
    return j.select("l_orderkey", "l_linenumber", D.named_port_range(
        F.col("from_port"), F.col("from_name"), F.col("to_port"), F.col("to_name")).alias("port_label"))


@query("join_missing_dim_default", section=S, sql=f"""
SELECT l.l_orderkey,
       CAST(sum(coalesce(f.vcpus, 0)) AS BIGINT) AS cores,
       CAST(sum(coalesce(f.ram, 0)) AS BIGINT) AS ram
FROM lineitem l LEFT JOIN (SELECT p_partkey, 1 + p_size % 8 AS vcpus, 512 * (1 + p_size % 16) AS ram
                           FROM part) f ON f.p_partkey = {V.PART_KEY_SQL}
GROUP BY l.l_orderkey
""")
def join_missing_dim_default(spark, sf_dir):
    """Quota cost per server when some flavors are gone: a missing dimension counts 0."""
    t = Tables(spark, sf_dir)
    fl = V.flavors(t.part).select(F.col("flavor_id").alias("part_id"), "vcpus", "ram")
    j = lookup(t.lineitem.select("l_orderkey", V.part_key().alias("part_id")), fl, "part_id")
    return j.groupBy("l_orderkey").agg(F.sum(F.coalesce("vcpus", F.lit(0))).cast("bigint").alias("cores"),
                                       F.sum(F.coalesce("ram", F.lit(0))).cast("bigint").alias("ram"))


@query("join_user_project", section=S, sql="""
SELECT e.event_id, c.c_name AS user_name, n.n_name AS project_name
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
""")
def join_user_project(spark, sf_dir):
    """Sample -> user and project, looked up once per id (a hash join, not N calls)."""
    t = Tables(spark, sf_dir)
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), "c_nationkey")
    j = lookup(t.events.select("event_id", "user_id"), users, "user_id")
    j = lookup(j, t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("project_name")),
               "c_nationkey")
    return j.select("event_id", "user_name", "project_name")


@query("semi_has_meter", section=S, sql="""
SELECT c_custkey FROM customer c
WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND e.event_type IN ('purchase', 'signup'))
""")
def semi_has_meter(spark, sf_dir):
    """Resources having any sample whose meter is one of the chosen meters."""
    t = Tables(spark, sf_dir)
    links = t.events.where(F.col("event_type").isin("purchase", "signup")).select(F.col("user_id").alias("c_custkey"))
    return semi_join(t.customer.select("c_custkey"), links, "c_custkey")


@query("semi_group_in_project", section=S, sql="""
SELECT c_custkey, c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O'
              AND o.o_orderpriority = '1-URGENT')
""")
def semi_group_in_project(spark, sf_dir):
    """Groups (customers) holding at least one role (open urgent order) in the project."""
    t = Tables(spark, sf_dir)
    roles = t.orders.where((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")) \
        .select(F.col("o_custkey").alias("c_custkey"))
    return semi_join(t.customer.select("c_custkey", "c_name"), roles, "c_custkey")


# Fixed display titles of the meters (our event types).
METER_TITLES = {"click": "Clicks", "view": "Page views", "purchase": "Purchases"}


@query("semi_instance_meters", section=S, sql="""
SELECT DISTINCT e.event_type AS meter,
       coalesce(CASE e.event_type WHEN 'click' THEN 'Clicks' WHEN 'view' THEN 'Page views'
                                  WHEN 'purchase' THEN 'Purchases' END, '') AS title
FROM events e WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_mktsegment = 'MACHINERY')
""")
def semi_instance_meters(spark, sf_dir):
    """Distinct, sorted meter names of instance resources with their title ('' when none)."""
    t = Tables(spark, sf_dir)
    inst = t.customer.where(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("user_id"))
    meters = semi_join(t.events.select("user_id", "event_type"), inst, "user_id") \
        .select(F.col("event_type").alias("meter")).distinct()
    titles = F.create_map(*[x for k, v in METER_TITLES.items() for x in (F.lit(k), F.lit(v))])
    return meters.select("meter", F.coalesce(titles[F.col("meter")], F.lit("")).alias("title")).orderBy("meter")


@query("anti_non_members", section=S, sql="""
SELECT c_custkey FROM customer c WHERE c_nationkey = 3
AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'
                AND o.o_orderpriority = '5-LOW')
""")
def anti_non_members(spark, sf_dir):
    """Users of a domain (nation 3) who are not members of the group."""
    t = Tables(spark, sf_dir)
    members = t.orders.where((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")) \
        .select(F.col("o_custkey").alias("c_custkey"))
    return anti_join(t.customer.where(F.col("c_nationkey") == 3).select("c_custkey"), members, "c_custkey")


@query("anti_missing_edge", section=S, sql="""
WITH routers AS (SELECT o_orderkey AS device_id, o_custkey AS network_id FROM orders WHERE o_orderstatus = 'F'),
     ports AS (SELECT l_orderkey AS device_id, l_suppkey AS network_id FROM lineitem)
SELECT p.device_id, p.network_id, false AS placeholder FROM ports p
WHERE p.device_id IN (SELECT device_id FROM routers)
UNION ALL
SELECT r.device_id, r.network_id, true AS placeholder FROM routers r
WHERE NOT EXISTS (SELECT 1 FROM ports p WHERE p.device_id = r.device_id AND p.network_id = r.network_id)
""")
def anti_missing_edge(spark, sf_dir):
    """Router ports plus a placeholder port for every router whose external
    network has no port row (anti join on the (device, network) pair)."""
    t = Tables(spark, sf_dir)
    routers = t.orders.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("device_id"), F.col("o_custkey").alias("network_id"))
    ports = t.lineitem.select(F.col("l_orderkey").alias("device_id"), F.col("l_suppkey").alias("network_id"))
    return EN.add_missing_edges(ports, routers, ["device_id", "network_id"], "device_id")


@query("anti_changed_files", section=S, sql="""
WITH local AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) AS key, n_chars AS size FROM documents),
     remote AS (SELECT d.source || '/' || CAST(d.doc_id AS VARCHAR) AS key, d.n_chars + l.toxic AS size
                FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT key, size FROM local l
WHERE NOT EXISTS (SELECT 1 FROM remote r WHERE r.key = l.key AND r.size = l.size)
""")
def anti_changed_files(spark, sf_dir):
    """Upload set: local keys absent remotely or present with another size."""
    t = Tables(spark, sf_dir)
    key = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    local = t.documents.select(key.alias("key"), F.col("n_chars").alias("size"))
    remote = t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id") \
        .select(key.alias("key"), (F.col("n_chars") + F.col("toxic")).alias("size"))
    return anti_join(local, remote, ["key", "size"])


@query("diff_snapshots", section=S, sql="""
WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE year(o_orderdate) = 1996),
     b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE year(o_orderdate) = 1997)
SELECT coalesce(a.id, b.id) AS id,
       CASE WHEN b.id IS NULL THEN 'removed' WHEN a.id IS NULL THEN 'added' ELSE 'kept' END AS change
FROM a FULL OUTER JOIN b ON a.id = b.id
""")
def diff_snapshots(spark, sf_dir):
    """Old and new node sets (customers active in 1996 vs 1997): removed, kept, added."""
    o = Tables(spark, sf_dir).orders
    def year(y):   # a range on the raw column, so the bounds reach the Parquet scan
        d = F.col("o_orderdate")
        return (d >= F.lit(f"{y}-01-01").cast("timestamp_ntz")) & (d < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz"))
    rows = o.where(year(1996) | year(1997)).select(F.col("o_custkey").alias("id"), "o_orderdate")
    return EN.diff_flags(rows, "id", year(1996), year(1997))


@query("diff_grants", section=S, sql="""
WITH cur AS (SELECT DISTINCT o_custkey AS user_id, o_orderpriority AS role FROM orders
             WHERE o_orderdate < TIMESTAMP '1998-01-01'),
     want AS (SELECT DISTINCT o_custkey AS user_id, o_orderpriority AS role FROM orders WHERE o_orderstatus <> 'F'),
     gone AS (SELECT * FROM cur EXCEPT SELECT * FROM want)
SELECT user_id, role, 'add' AS action FROM (SELECT * FROM want EXCEPT SELECT * FROM cur)
UNION ALL
SELECT user_id, role, CASE WHEN user_id = 47 AND EXISTS (SELECT 1 FROM gone WHERE user_id = 47 AND lower(role) = '1-urgent')
                           THEN 'blocked' ELSE 'revoke' END
FROM gone
""")
def diff_grants(spark, sf_dir):
    """Desired vs current (user, role): grants to add and to revoke; where the acting
    user (47) would lose the own admin role ('1-URGENT'), none of that user's go."""
    o = Tables(spark, sf_dir).orders
    rows = o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("role"), "o_orderdate", "o_orderstatus")
    return EN.diff_grant_flags(rows, F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"),
                               F.col("o_orderstatus") != "F", acting_user=47, admin_role="1-URGENT")


@query("lookup_meter_unit", section=S, sql="""
WITH m AS (SELECT event_type AS name, CASE WHEN value < 100 THEN 'count' ELSE 'B' END AS unit, event_id FROM events),
     first_unit AS (SELECT name, arg_min(unit, event_id) AS unit FROM m GROUP BY name),
     req AS (SELECT DISTINCT event_type AS meter FROM events
             UNION SELECT DISTINCT event_type || '.rate' FROM events)
SELECT r.meter, coalesce(f.unit, '') AS unit FROM req r LEFT JOIN first_unit f ON f.name = r.meter
""")
def lookup_meter_unit(spark, sf_dir):
    """Unit of the first meter (lowest sample id) with the chosen name, '' when none."""
    return EN.meter_units(Tables(spark, sf_dir).events)


@query("resolve_endpoint", section=S, sql="""
WITH ep AS (
  SELECT n.n_name AS service, CASE WHEN n.n_regionkey = 0 THEN 'identity' ELSE 'compute' END AS stype,
         r.r_name AS region,
         CASE WHEN s.s_acctbal < 0 THEN 'internal' WHEN s.s_acctbal < 5000 THEN 'public' ELSE 'admin' END AS iface,
         'http://' || lower(replace(s.s_name, '#', '-')) || '.example/' AS url, s.s_suppkey
  FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)
SELECT service,
       coalesce(arg_min(url, s_suppkey) FILTER (WHERE iface = 'public' AND (stype = 'identity' OR region = 'EUROPE')),
                arg_min(url, s_suppkey) FILTER (WHERE iface = 'internal' AND (stype = 'identity' OR region = 'EUROPE')))
         AS url
FROM ep GROUP BY service
""")
def resolve_endpoint(spark, sf_dir):
    """First endpoint of each service for a region and interface ('public',
    falling back to 'internal'); identity services ignore the region."""
    t = Tables(spark, sf_dir)
    ep = lookup(lookup(t.supplier, t.nation, F.col("s_nationkey") == F.col("n_nationkey")),
                t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("service"),
        F.when(F.col("n_regionkey") == 0, "identity").otherwise("compute").alias("stype"),
        F.col("r_name").alias("region"),
        F.when(F.col("s_acctbal") < 0, "internal").when(F.col("s_acctbal") < 5000, "public").otherwise("admin")
         .alias("iface"),
        F.concat(F.lit("http://"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".example/"))
         .alias("url"),
        "s_suppkey")
    return EN.resolve_endpoint(ep, "service", region="EUROPE", interface="public", fallback="internal")
