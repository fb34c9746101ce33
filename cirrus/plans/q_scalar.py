"""Queries for SURVEY section 2.8: scalar string, number, map and JSON functions.
All are Column expressions evaluated inside whole-stage codegen over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirrus.functions import display as D
from cirrus.plans import views as V
from cirrus.plans.registry import query
from cirrus.sources.tables import Tables

S = "2.8"


def _size_sql(x: str, fmt: str) -> str:
    """SQL twin of ``display.size_format`` for a non-null numeric expression."""
    def num(div):
        if fmt == "int":
            return f"CAST(CAST(floor({x} / {div}) AS BIGINT) AS VARCHAR)"
        return f"printf('%.1f', round({x} / {div}, 1))"
    return f"""CASE WHEN {x} < 1024 THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR)
  WHEN {x} < 1048576.0 THEN {num('1024.0')} || ' KB'
  WHEN {x} < 1073741824.0 THEN {num('1048576.0')} || ' MB'
  WHEN {x} < 1099511627776.0 THEN {num('1073741824.0')} || ' GB'
  WHEN {x} < 1125899906842624.0 THEN {num('1099511627776.0')} || ' TB'
  ELSE {num('1125899906842624.0')} || ' PB' END"""


@query("size_format", section=S, sql=f"""
SELECT doc_id, {_size_sql('n_chars', 'float')} AS size_small,
       {_size_sql('n_chars * 1000.0', 'float')} AS size_text,
       {_size_sql('n_chars * 1000000000.0', 'int')} AS size_int
FROM documents
""")
def size_format(spark, sf_dir):
    """Bytes to '512' / '1.5 KB' / '3 GB' text (one decimal or integer units)."""
    d = Tables(spark, sf_dir).documents
    n = F.col("n_chars").cast("double")
    return d.select("doc_id", D.size_format(n).alias("size_small"), D.size_format(n * 1000.0).alias("size_text"),
                    D.size_format(n * 1e9, "int").alias("size_int"))


@query("mb_gb_format", section=S, sql=f"""
SELECT flavor_id,
       CASE WHEN coalesce(ram, 0) = 0 THEN '0' ELSE replace({_size_sql('ram * 1048576.0', 'int')}, ' ', '') END AS ram_text,
       CASE WHEN coalesce(ram, 0) = 0 THEN '0' ELSE {_size_sql('ram * 1048576.0', 'float')} END AS ram_float,
       replace({_size_sql('disk * 1073741824.0', 'float')}, ' ', '') AS disk_text
FROM ({V.FLAVORS_SQL})
""")
def mb_gb_format(spark, sf_dir):
    """Megabyte and gigabyte text variants ('1GB', '1.5 GB', '20.0GB'); 0 MB -> '0'."""
    f = V.flavors(Tables(spark, sf_dir).part)
    return f.select("flavor_id", D.mb_format(F.col("ram")).alias("ram_text"),
                    D.mb_float_format(F.col("ram")).alias("ram_float"), D.disk_gb_format(F.col("disk")).alias("disk_text"))


@query("bytes_to_gb_ceil", section=S, sql="""
SELECT doc_id, CAST(ceil(n_chars * 1048576.0 / 1073741824.0) AS BIGINT) AS gb FROM documents
""")
def bytes_to_gb_ceil(spark, sf_dir):
    """Sizes rounded up to whole gigabytes."""
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", D.bytes_to_gb_ceil(F.col("n_chars") * 1048576).alias("gb"))


@query("number_format", section=S, sql="""
SELECT l_orderkey, l_linenumber, format('{:,.2f}', l_extendedprice) AS price_text FROM lineitem
""")
def number_format(spark, sf_dir):
    """Two fixed decimals with thousands commas."""
    li = Tables(spark, sf_dir).lineitem
    return li.select("l_orderkey", "l_linenumber", D.number_format(F.col("l_extendedprice"), 2).alias("price_text"))


_INITCAP_SQL = ("array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), "
                "lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ')")


@query("label_case", section=S, sql=f"""
SELECT event_id, {_INITCAP_SQL.format(x='event_type')} AS label,
       {_INITCAP_SQL.format(x="upper(event_type) || '_in_progress'")} AS status_desc
FROM events
""")
def label_case(spark, sf_dir):
    """'_' to space and title case ('CLICK_IN_PROGRESS' -> 'Click In Progress')."""
    e = Tables(spark, sf_dir).events
    return e.select("event_id", D.label_case(F.col("event_type")).alias("label"),
                    D.label_case(F.concat(F.upper("event_type"), F.lit("_in_progress"))).alias("status_desc"))


@query("quota_label", section=S, sql="""
WITH q AS (SELECT c_custkey AS tenant_id,
                  CASE WHEN c_acctbal < 0 THEN 'inf'::DOUBLE ELSE floor(c_acctbal / 500) END AS available FROM customer)
SELECT tenant_id, CASE WHEN available = 'inf'::DOUBLE THEN 'No Limit'
                       ELSE CAST(CAST(available AS BIGINT) AS VARCHAR) || ' instances Available' END AS label
FROM q
""")
def quota_label(spark, sf_dir):
    """inf -> 'No Limit', otherwise 'N unit Available'."""
    c = Tables(spark, sf_dir).customer
    avail = F.when(F.col("c_acctbal") < 0, F.lit(float("inf"))).otherwise(F.floor(F.col("c_acctbal") / 500).cast("double"))
    return c.select(F.col("c_custkey").alias("tenant_id"), D.quota_label(avail, "instances").alias("label"))


@query("flavor_label", section=S, sql=f"""
SELECT l.l_orderkey, l.l_linenumber,
       coalesce(f.flavor_name || ' | ' || replace({_size_sql('f.ram * 1048576.0', 'int')}, ' ', '') || ' RAM | '
                || CAST(f.vcpus AS VARCHAR) || ' VCPU | ' || replace({_size_sql('f.disk * 1073741824.0', 'float')}, ' ', '')
                || ' Disk', 'Not available') AS size_label
FROM lineitem l LEFT JOIN ({V.FLAVORS_SQL}) f ON f.flavor_id = {V.PART_KEY_SQL}
""")
def flavor_label(spark, sf_dir):
    """'name | RAM | VCPU | Disk' for a server's flavor; 'Not available' when the flavor is gone."""
    from cirrus.operators.joins import lookup
    t = Tables(spark, sf_dir)
    j = lookup(t.lineitem.select("l_orderkey", "l_linenumber", V.part_key().alias("part_id")), V.flavors(t.part),
               F.col("part_id") == F.col("flavor_id"))
    return j.select("l_orderkey", "l_linenumber",
                    D.flavor_label(F.col("flavor_name"), F.col("ram"), F.col("vcpus"), F.col("disk")).alias("size_label"))


RULES_SQL = """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 7 THEN 'IPv6' ELSE 'IPv4' END AS ethertype,
  CASE l_returnflag WHEN 'A' THEN 'TCP' WHEN 'N' THEN 'udp' ELSE CAST(l_linenumber + 40 AS VARCHAR) END AS protocol,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS from_port,
  CASE WHEN l_returnflag = 'R' THEN NULL
       ELSE CAST(l_quantity AS INTEGER) + CASE WHEN l_linenumber > 5 THEN 10 ELSE 0 END END AS to_port,
  CASE l_linestatus WHEN 'O' THEN 'ingress' ELSE 'egress' END AS direction,
  CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_suppkey % 256 AS VARCHAR) || '.0.0.0/8' END AS cidr
FROM lineitem"""


def _rules(t: Tables):
    li = t.lineitem
    q = F.col("l_quantity").cast("int")
    ret = F.col("l_returnflag") == "R"
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 7, "IPv6").otherwise("IPv4").alias("ethertype"),
        F.when(F.col("l_returnflag") == "A", "TCP").when(F.col("l_returnflag") == "N", "udp")
         .otherwise((F.col("l_linenumber") + 40).cast("string")).alias("protocol"),
        F.when(~ret, q).alias("from_port"),
        F.when(~ret, q + F.when(F.col("l_linenumber") > 5, 10).otherwise(0)).alias("to_port"),
        F.when(F.col("l_linestatus") == "O", "ingress").otherwise("egress").alias("direction"),
        F.when(F.col("l_tax") != 0, F.concat((F.col("l_suppkey") % 256).cast("string"), F.lit(".0.0.0/8")))
         .alias("cidr"))


@query("rule_text", section=S, sql=f"""
SELECT l_orderkey, l_linenumber,
  'ALLOW ' || ethertype || ' ' ||
  CASE WHEN coalesce(from_port, 0) <> 0 THEN
         CASE WHEN from_port = to_port THEN CAST(from_port AS VARCHAR) || '/' || lower(protocol)
              ELSE CAST(from_port AS VARCHAR) || '-' || CAST(to_port AS VARCHAR) || '/' || lower(protocol) END
       WHEN protocol IS NOT NULL AND protocol <> '' THEN
         CASE WHEN TRY_CAST(protocol AS INTEGER) IS NOT NULL THEN 'ip_proto=' || CAST(TRY_CAST(protocol AS INTEGER) AS VARCHAR)
              ELSE protocol END
       ELSE '' END
  || ' ' || CASE WHEN direction = 'egress' THEN 'to' ELSE 'from' END || ' ' || coalesce(cidr, 'ANY') AS rule
FROM ({RULES_SQL})
""")
def rule_text(spark, sf_dir):
    """Readable rule sentence: 'ALLOW IPv4 12-22/tcp from 7.0.0.0/8'."""
    r = _rules(Tables(spark, sf_dir))
    return r.select("l_orderkey", "l_linenumber", D.rule_text(
        F.col("ethertype"), F.col("protocol"), F.col("from_port"), F.col("to_port"), F.col("direction"),
        F.lit(None).cast("string"), F.col("cidr")).alias("rule"))


@query("port_range_text", section=S, sql=f"""
SELECT l_orderkey, l_linenumber,
       CASE WHEN from_port = to_port THEN CAST(from_port AS VARCHAR)
            ELSE CAST(from_port AS VARCHAR) || ' - ' || CAST(to_port AS VARCHAR) END AS port_range,
       coalesce(cidr, CASE WHEN ethertype = 'IPv6' THEN '::/0' ELSE '0.0.0.0/0' END) || ' (CIDR)' AS remote
FROM ({RULES_SQL})
""")
def port_range_text(spark, sf_dir):
    """'a' or 'a - b'; a missing CIDR shows the any-address of the IP version."""
    r = _rules(Tables(spark, sf_dir))
    return r.select("l_orderkey", "l_linenumber", D.port_range_text(F.col("from_port"), F.col("to_port")).alias("port_range"),
                    D.default_cidr(F.col("cidr"), F.col("ethertype")).alias("remote"))


@query("admin_state", section=S, sql="""
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linestatus = 'O' THEN 'UP' ELSE 'DOWN' END AS admin,
       CASE l_partkey % 11 WHEN 0 THEN 'NO STATE' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'BLOCKED' WHEN 3 THEN 'PAUSED'
            WHEN 4 THEN 'SHUTDOWN' WHEN 5 THEN 'SHUTOFF' WHEN 6 THEN 'CRASHED' WHEN 7 THEN 'SUSPENDED'
            WHEN 8 THEN 'FAILED' WHEN 9 THEN 'BUILDING' ELSE '' END AS power,
       CASE l_returnflag WHEN 'R' THEN 'Egress' ELSE 'Ingress' END AS direction,
       CASE l_returnflag WHEN 'A' THEN 'TCP' WHEN 'R' THEN 'ICMP' ELSE 'Any' END AS protocol
FROM lineitem
""")
def admin_state(spark, sf_dir):
    """Boolean to UP/DOWN, power-state code to label, direction and protocol labels."""
    li = Tables(spark, sf_dir).lineitem
    direction = F.when(F.col("l_returnflag") == "R", "egress").when(F.col("l_returnflag") == "A", "INGRESS")
    proto = F.when(F.col("l_returnflag") == "A", "tcp").when(F.col("l_returnflag") == "R", "icmp")
    return li.select("l_orderkey", "l_linenumber", D.admin_state(F.col("l_linestatus") == "O").alias("admin"),
                     D.power_state_label((F.col("l_partkey") % 11).cast("int")).alias("power"),
                     D.direction_label(direction).alias("direction"), D.protocol_label(proto).alias("protocol"))


# Resource type and status texts assigned to parts (data derivation for the classifier).
RESOURCE_TYPES = ["Cloud::Compute::Instance", "Cloud::Compute::Server", "Cloud::Net::LoadBalancer",
                  "Cloud::Data::DBInstance", "Cloud::Data::Database", "Cloud::Orchestration::stack", "Cloud::Net::Port",
                  "Cloud::Orchestration::Stack"]
RESOURCE_STATUSES = ["CREATE_IN_PROGRESS", "CREATE_FAILED", "DELETE_COMPLETE", "INIT_COMPLETE", "CREATE_COMPLETE",
                     "UPDATE_IN_PROGRESS"]


def _sql_list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query("classify_type_status", section=S, sql=f"""
WITH r AS (SELECT p_partkey, {_sql_list(RESOURCE_TYPES)}[p_size % 8 + 1] AS rtype_text,
                  {_sql_list(RESOURCE_STATUSES)}[p_partkey % 6 + 1] AS status_text FROM part),
c AS (SELECT p_partkey,
        CASE WHEN contains(rtype_text, 'LoadBalancer') THEN 'LB'
             WHEN contains(rtype_text, 'DBInstance') OR contains(rtype_text, 'Database') THEN 'DB'
             WHEN contains(rtype_text, 'Instance') OR contains(rtype_text, 'Server') THEN 'SERVER'
             WHEN contains(rtype_text, 'stack') THEN 'STACK' ELSE 'UNKNOWN' END AS rtype,
        CASE WHEN contains(status_text, 'IN_PROGRESS') THEN 'IN_PROGRESS' WHEN contains(status_text, 'FAILED') THEN 'FAILED'
             WHEN contains(status_text, 'DELETE') THEN 'DELETE' WHEN contains(status_text, 'INIT') THEN 'INIT'
             ELSE 'COMPLETE' END AS rstatus FROM r)
SELECT p_partkey, rtype, rstatus, rtype || '_' || rstatus AS state FROM c
""")
def classify_type_status(spark, sf_dir):
    """Ordered pattern rules to a resource type and status, combined as TYPE_STATUS."""
    p = Tables(spark, sf_dir).part
    rt = F.element_at(F.array(*[F.lit(x) for x in RESOURCE_TYPES]), (F.pmod("p_size", F.lit(8)) + 1).cast("int"))
    rs = F.element_at(F.array(*[F.lit(x) for x in RESOURCE_STATUSES]),
                      (F.pmod("p_partkey", F.lit(6)) + 1).cast("int"))
    c = p.select("p_partkey", D.classify_type(rt).alias("rtype"), D.classify_status(rs).alias("rstatus"))
    return c.withColumn("state", F.concat_ws("_", "rtype", "rstatus"))


KEY_RE = r"^[a-z]+://([^?#]*)"


@query("path_breadcrumbs", section=S, sql=f"""
WITH p AS (SELECT page_id, string_split(regexp_extract(url, '{KEY_RE}', 1), '/') AS parts FROM pages)
SELECT page_id, i AS level, parts[i] AS name, array_to_string(parts[1:i], '/') || '/' AS path,
       parts[len(parts)] AS object_name
FROM p, LATERAL (SELECT unnest(range(1, len(p.parts))) AS i)
""")
def path_breadcrumbs(spark, sf_dir):
    """Every ancestor folder (level, name, path 'a/b/') of each object key, with
    the object's own name (the part after the last '/')."""
    p = Tables(spark, sf_dir).pages.select("page_id", F.split(F.regexp_extract("url", KEY_RE, 1), "/").alias("parts"))
    folders = p.select("page_id", "parts", F.posexplode(F.slice("parts", 1, F.size("parts") - 1)).alias("pos", "name"))
    return folders.select("page_id", (F.col("pos") + 1).cast("bigint").alias("level"), "name",
                          F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("pos") + 1), "/"), F.lit("/"))
                           .alias("path"),
                          F.element_at("parts", -1).alias("object_name"))


@query("map_entries_text", section=S, sql="""
SELECT event_id,
       array_to_string(list_transform(json_keys(props), lambda k: k || ' = ' || json_extract_string(props, '$.' || k)),
                       ', ') AS meta_text
FROM events
""")
def map_entries_text(spark, sf_dir):
    """Metadata map rendered as 'k = v' items."""
    e = Tables(spark, sf_dir).events
    return e.select("event_id", D.map_entries_text(F.from_json("props", "map<string,string>")).alias("meta_text"))


@query("nested_json_get", section=S, sql="""
WITH m AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events)
SELECT event_id,
       coalesce(nullif(CASE WHEN k % 3 = 0 THEN event_type || '-' || CAST(k AS VARCHAR) END, ''),
                nullif(CASE WHEN k > 50 THEN 'res-' || CAST(k AS VARCHAR) END, ''), '') AS name
FROM m
""")
def nested_json_get(spark, sf_dir):
    """Resource name from its metadata: name, else display_name, else ''."""
    e = Tables(spark, sf_dir).events
    k = F.get_json_object("props", "$.k").cast("bigint")
    meta = F.create_map(
        F.lit("name"), F.when(k % 3 == 0, F.concat("event_type", F.lit("-"), k.cast("string"))),
        F.lit("display_name"), F.when(k > 50, F.concat(F.lit("res-"), k.cast("string"))))
    return e.select("event_id", D.metadata_name(meta).alias("name"))


VARIANT_META_SQL = """CASE event_id % 5 WHEN 0 THEN props
    WHEN 1 THEN '{"k": "' || event_type || '", "tags": ["' || event_type || '", ' || user_id || ']}'
    WHEN 2 THEN '{"k": null}'
    WHEN 3 THEN '{"other": {"k": ' || user_id || '.5}}'
    ELSE '{"k": {"name": "' || event_type || '"}, "other": {"k": true}}' END"""


@query("variant_meta_get", section=S, sql=f"""
WITH m AS (SELECT event_id, ({VARIANT_META_SQL})::JSON AS meta FROM events),
t AS (SELECT event_id, meta, json_type(meta, '$.k') AS t, json_type(meta, '$.other.k') AS o FROM m)
SELECT event_id,
       CASE WHEN t IS NULL THEN 'missing' WHEN t = 'NULL' THEN 'null' WHEN t IN ('BIGINT', 'UBIGINT') THEN 'number'
            WHEN t = 'VARCHAR' THEN 'text' WHEN t = 'OBJECT' THEN 'object' ELSE t END AS kind,
       CASE WHEN t IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract(meta, '$.k') AS BIGINT) END AS k_number,
       CASE WHEN t = 'OBJECT' THEN json_extract_string(meta, '$.k.name') WHEN t = 'VARCHAR' THEN json_extract_string(meta, '$.k') END AS name,
       CASE WHEN o = 'DOUBLE' THEN CAST(json_extract(meta, '$.other.k') AS DOUBLE) END AS other_number,
       json_extract_string(meta, '$.tags[0]') AS first_tag
FROM t
""")
def variant_meta_get(spark, sf_dir):
    """Metadata without a declared schema as VARIANT: a key may hold a number, a text, an
    object or null, or be missing, and each is told apart."""
    e = Tables(spark, sf_dir).events
    text, user = F.col("event_type"), F.col("user_id").cast("string")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    made = {1: F.concat(F.lit('{"k": '), q(text), F.lit(', "tags": ['), q(text), F.lit(", "), user, F.lit("]}")), 2: F.lit('{"k": null}'),
            3: F.concat(F.lit('{"other": {"k": '), user, F.lit(".5}}")),
            4: F.concat(F.lit('{"k": {"name": '), q(text), F.lit('}, "other": {"k": true}}'))}
    meta = F.col("props")
    for r, c in made.items():
        meta = F.when(F.col("event_id") % 5 == r, c).otherwise(meta)
    return D.variant_fields(e.select("event_id", F.try_parse_json(meta).alias("meta")), "meta")


@query("to_json_text", section=S, sql="""
SELECT c_custkey, to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_mktsegment': c_mktsegment})::VARCHAR AS doc
FROM customer
""")
def to_json_text(spark, sf_dir):
    """Nested data serialised to JSON text."""
    c = Tables(spark, sf_dir).customer
    return c.select("c_custkey", D.to_json_text("c_custkey", "c_name", "c_mktsegment").alias("doc"))
