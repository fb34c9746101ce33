"""Queries for SURVEY section 2.2: projections, filters, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirrus.functions import display as D
from cirrus.functions import status as ST
from cirrus.operators import quality as Q
from cirrus.operators import table as TB
from cirrus.operators import text_index as TI
from cirrus.operators import usage as U
from cirrus.plans import views as V
from cirrus.plans.registry import query
from cirrus.session import scratch_dir
from cirrus.sources.files import save_clustered
from cirrus.sources.tables import Tables

S = "2.2"

# pages: path part of the url (no scheme/host, no query or fragment)
PATH_RE = r"^[a-z]+://[^/?#]+([^?#]*)"
TITLE_RE = r"<title>(.*?)</title>"


@query("project_columns", section=S, sql="""
SELECT c_name, c_custkey, c_mktsegment AS ext__segment FROM customer
""")
def project_columns(spark, sf_dir):
    """Declared columns with inheritance: the parent's columns resolve first, the
    Meta column list keeps and orders them, ':' in a key becomes '__'."""
    base = TB.TableSpec([TB.ColumnSpec("c_custkey"), TB.ColumnSpec("c_name")])
    spec = TB.TableSpec([TB.ColumnSpec("c_acctbal"), TB.ColumnSpec("ext:segment", source="c_mktsegment")],
                        parents=[base], only=["c_name", "c_custkey", "ext:segment"])
    return spec.apply(Tables(spark, sf_dir).customer)


@query("project_derived", section=S, sql="""
SELECT l_orderkey, l_linenumber, l_quantity AS quantity,
       l_extendedprice * (1 - l_discount) AS net_price,
       l_linestatus AS status, CAST(NULL AS VARCHAR) AS missing_attr
FROM lineitem
""")
def project_derived(spark, sf_dir):
    """Cell value from an attribute, a callable, or a dict key; otherwise null."""
    li = Tables(spark, sf_dir).lineitem.withColumn(
        "attrs", F.create_map(F.lit("status"), F.col("l_linestatus"), F.lit("flag"), F.col("l_returnflag")))
    spec = TB.TableSpec([
        TB.ColumnSpec("l_orderkey"), TB.ColumnSpec("l_linenumber"),
        TB.ColumnSpec("quantity", source="l_quantity"),
        TB.ColumnSpec("net_price", source=lambda df: F.col("l_extendedprice") * (1 - F.col("l_discount"))),
        TB.ColumnSpec("status", map_key=("attrs", "status")),
        TB.ColumnSpec("missing_attr", source="no_such_attribute"),
    ])
    return spec.apply(li)


@query("fill_empty", section=S, sql="""
SELECT c.c_custkey,
       coalesce(strftime(u.first_urgent, '%Y-%m-%d'), '-') AS first_urgent_open,
       coalesce(CAST(u.n_urgent AS VARCHAR), '-') AS n_urgent_open
FROM customer c LEFT JOIN (
  SELECT o_custkey, min(o_orderdate) AS first_urgent, count(*) AS n_urgent
  FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' GROUP BY o_custkey) u
ON c.c_custkey = u.o_custkey
""")
def fill_empty(spark, sf_dir):
    """Left-joined cells show '-' only where the value is null."""
    t = Tables(spark, sf_dir)
    urgent = (t.orders.where((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"))
              .groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_urgent"),
                                        F.count(F.lit(1)).alias("n_urgent")))
    j = t.customer.select("c_custkey").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey",
                    D.fill_empty(F.date_format("first_urgent", "yyyy-MM-dd")).alias("first_urgent_open"),
                    D.fill_empty(F.col("n_urgent")).alias("n_urgent_open"))


@query("map_display_choices", section=S, sql="""
SELECT o_orderkey,
       CASE lower(o_orderstatus) WHEN 'o' THEN 'Open' WHEN 'f' THEN 'Finished' WHEN 'p' THEN 'In Progress'
            ELSE o_orderstatus END AS status_label,
       CASE lower(o_orderpriority) WHEN '1-urgent' THEN 'Urgent!'
            ELSE replace(lower(o_orderpriority), '-', ' ') END AS priority_label
FROM orders
""")
def map_display_choices(spark, sf_dir):
    """Labels by case-insensitive choice; unmatched values go through the filters."""
    o = Tables(spark, sf_dir).orders
    return o.select(
        "o_orderkey",
        D.map_display_choices(F.col("o_orderstatus"), {"O": "Open", "F": "Finished", "P": "In Progress"})
         .alias("status_label"),
        D.map_display_choices(F.col("o_orderpriority"), {"1-URGENT": "Urgent!"},
                              filters=[F.lower, lambda c: F.replace(c, F.lit("-"), F.lit(" "))])
         .alias("priority_label"))


@query("truncate_text", section=S, sql="""
SELECT doc_id,
       CASE WHEN length(text) > 40 THEN substring(text, 1, 37) || '...' ELSE text END AS title,
       substring(text, 1, 3) AS tiny
FROM documents
""")
def truncate_text(spark, sf_dir):
    """Cut whole texts to a display size with '...' (size > 3) or a plain cut."""
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", D.truncate_text(F.col("text"), 40).alias("title"),
                    D.truncate_text(F.col("text"), 3).alias("tiny"))


_DEFAULT_STATUS_SQL = """CASE lower(coalesce({c}, 'none'))
  WHEN 'enabled' THEN true WHEN 'true' THEN true WHEN 'up' THEN true WHEN 'yes' THEN true
  WHEN 'active' THEN true WHEN 'on' THEN true
  WHEN 'disabled' THEN false WHEN 'down' THEN false WHEN 'false' THEN false WHEN 'inactive' THEN false
  WHEN 'no' THEN false WHEN 'off' THEN false ELSE NULL END"""


@query("status_of_value", section=S, sql=f"""
WITH s AS ({V.SERVERS_SQL})
SELECT s.server_id,
       {_DEFAULT_STATUS_SQL.format(c="s.state")} AS state_status,
       CASE lower(o.o_orderstatus) WHEN 'f' THEN true WHEN 'p' THEN false ELSE NULL END AS order_status
FROM s JOIN orders o ON o.o_orderkey = s.server_id
""")
def status_of_value(spark, sf_dir):
    """Status column: first case-insensitive choice gives True/None/False."""
    s = V.servers(Tables(spark, sf_dir).orders, keep=("o_orderstatus",))
    return s.select("server_id",
                    ST.status_of_value(F.col("state")).alias("state_status"),
                    ST.status_of_value(F.col("o_orderstatus"), [("f", True), ("p", False)]).alias("order_status"))


@query("row_status", section=S, sql="""
SELECT l_orderkey, l_linenumber,
       (CASE lower(l_returnflag) WHEN 'n' THEN true WHEN 'r' THEN false ELSE NULL END)
       AND (CASE lower(l_linestatus) WHEN 'f' THEN true ELSE NULL END) AS row_status
FROM lineitem
""")
def row_status(spark, sf_dir):
    """Row status: any False -> False, else any None -> None, else True."""
    li = Tables(spark, sf_dir).lineitem
    s1 = ST.status_of_value(F.col("l_returnflag"), [("n", True), ("a", None), ("r", False)])
    s2 = ST.status_of_value(F.col("l_linestatus"), [("f", True), ("o", None)])
    return li.select("l_orderkey", "l_linenumber", ST.row_status(s1, s2).alias("row_status"))


@query("filter_contains", section=S, sql="""
SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')
""")
def filter_contains(spark, sf_dir):
    """Case-insensitive substring filter on one column."""
    return TB.filter_contains(Tables(spark, sf_dir).part.select("p_partkey", "p_name"), "p_name", "RING")


@query("filter_contains_any", section=S, sql="""
SELECT p_partkey, p_name, p_type FROM part
WHERE contains(lower(p_name), 'la') OR contains(lower(p_type), 'la')
""")
def filter_contains_any(spark, sf_dir):
    """Case-insensitive substring filter over several columns (OR); null cells never match."""
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_type")
    return TB.filter_contains_any(p, ["p_name", "p_type"], "LA")


@query("filter_contains_indexed", section=S, sql="""
SELECT p_partkey, p_name, p_type FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'econ')
   OR contains(lower(p_name), 'econ') OR contains(lower(p_type), 'ring')
""")
def filter_contains_indexed(spark, sf_dir):
    """Substring filter over two columns by trigram postings: only groups of rows that hold
    all trigrams of the term are scanned."""
    parts = Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_type")
    index = TI.build(parts, ["p_name", "p_type"], ["p_type", "p_name", "p_partkey"], scratch_dir(spark, "grams"), groups=32)
    return index.contains_any(["p_name", "p_type"], "RING", "Econ")


@query("filter_wildcard_indexed", section=S, sql="""
SELECT page_id, url FROM pages WHERE lower(url) LIKE '%example%/en/%html%' ESCAPE '\\'
""")
def filter_wildcard_indexed(spark, sf_dir):
    """The ordered wildcard by trigram postings of the URLs, kept in their order."""
    pages = Tables(spark, sf_dir).pages.select("page_id", "url")
    index = TI.build(pages, ["url"], ["url", "page_id"], scratch_dir(spark, "grams"), groups=32)
    return index.wildcard("url", "Example*/EN/*html  ignored-second-term")


@query("filter_regex_row", section=S, sql="""
SELECT s_suppkey, s_name, s_acctbal FROM supplier
WHERE regexp_matches(s_name || CAST(s_nationkey AS VARCHAR) || CAST(s_acctbal AS VARCHAR),
                     'supplier#0+[1-3]5', 'i')
""")
def filter_regex_row(spark, sf_dir):
    """Live row filter: case-insensitive regex over the visible cell text."""
    s = Tables(spark, sf_dir).supplier
    return TB.filter_regex_row(s, ["s_name", "s_nationkey", "s_acctbal"], "supplier#0+[1-3]5") \
        .select("s_suppkey", "s_name", "s_acctbal")


@query("filter_wildcard", section=S, sql="""
SELECT page_id, url FROM pages WHERE lower(url) LIKE '%example%/en/%html%' ESCAPE '\\'
""")
def filter_wildcard(spark, sf_dir):
    """Ordered '*' wildcard on the lower-cased name; only the first term counts."""
    return TB.filter_wildcard(Tables(spark, sf_dir).pages.select("page_id", "url"), "url",
                              "Example*/EN/*html  ignored-second-term")


@query("filter_query", section=S, sql="""
SELECT event_id, ts, user_id, event_type, value FROM events
WHERE user_id IN (3, 7, 11) AND ts >= TIMESTAMP '2024-01-05 00:00:00'
  AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND event_type = 'click'
""")
def filter_query(spark, sf_dir):
    """(field, op, value) conditions: OR within a field's eq values, AND across;
    a single id has priority over the id list of its field."""
    conds = (TB.id_conditions(singles={"user_id": None, "event_type": "click"},
                              lists={"user_id": [3, 7, 11], "event_type": ["view", "error"]})
             + TB.range_conditions("ts", "2024-01-05 00:00:00", "2024-01-20 00:00:00"))
    e = Tables(spark, sf_dir).events.select("event_id", "ts", "user_id", "event_type", "value")
    return TB.filter_query(e, conds)


@query("filter_equal_attrs", section=S, sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'
""")
def filter_equal_attrs(spark, sf_dir):
    """Rows equal to every given attribute value."""
    o = Tables(spark, sf_dir).orders
    return TB.filter_equal_attrs(o, o_orderstatus="O", o_orderpriority="1-URGENT") \
        .select("o_orderkey", "o_custkey", "o_totalprice")


# documents as shared images: public = English, owner = source; the user's tenant
# is src1 and the tenants with their own filter button are src2 and src3
USER_TENANT = "src1"
FILTER_TENANTS = ["src2", "src3"]


def doc_categories():
    """Ownership categories of a document (a row may carry two)."""
    return TB.ownership_categories(F.col("lang") == "en", F.col("source"), USER_TENANT, FILTER_TENANTS)


DOC_CATEGORIES_SQL = """list_filter([CASE WHEN lang = 'en' THEN 'public' END,
             CASE WHEN source = 'src1' THEN 'project' WHEN source IN ('src2', 'src3') THEN source
                  WHEN NOT coalesce(lang = 'en', false) THEN 'shared' END], lambda x: x IS NOT NULL)"""


@query("filter_by_category", section=S, sql=f"""
SELECT doc_id, n_chars FROM (SELECT *, {DOC_CATEGORIES_SQL} AS cats FROM documents)
WHERE list_contains(cats, 'shared')
""")
def filter_by_category(spark, sf_dir):
    """Rows in the category of the pressed button ('shared'); no value -> all rows."""
    d = Tables(spark, sf_dir).documents.withColumn("cats", doc_categories())
    return TB.filter_by_category(d, "cats", "shared").select("doc_id", "n_chars")


@query("filter_not_in_nullsafe", section=S, sql="""
SELECT doc_id, source FROM documents WHERE source IS NULL OR source NOT IN ('src0', 'src1')
""")
def filter_not_in_nullsafe(spark, sf_dir):
    """Drop listed values but keep nulls (unlike SQL NOT IN)."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "source")
    return TB.filter_not_in_nullsafe(d, "source", ["src0", "src1"])


@query("filter_kind_split", section=S, sql=f"""
WITH p AS (SELECT page_id, regexp_extract(url, '{PATH_RE}', 1) AS path FROM pages)
SELECT page_id, path, 'folder' AS kind FROM p WHERE ends_with(path, '/')
UNION ALL
SELECT page_id, path, 'object' AS kind FROM p WHERE NOT ends_with(path, '/')
""")
def filter_kind_split(spark, sf_dir):
    """One listing split into folders and objects, by a label in one scan."""
    p = Tables(spark, sf_dir).pages.select("page_id", F.regexp_extract("url", PATH_RE, 1).alias("path"))
    return p.withColumn("kind", F.when(F.col("path").endswith("/"), "folder").otherwise("object"))


@query("filter_active_only", section=S, sql=f"""
SELECT server_id, tenant_id, state FROM ({V.SERVERS_SQL}) WHERE ended_at IS NULL
""")
def filter_active_only(spark, sf_dir):
    """Hide terminated servers (ended_at set) unless terminated ones are asked for."""
    # only open orders have no end; said of the status itself, so that the scan gets it
    s = V.servers(Tables(spark, sf_dir).orders.where(F.col("o_orderstatus") == "O"))
    return U.filter_active_only(s, show_terminated=False).select("server_id", "tenant_id", "state")


@query("filter_unassigned_sorted", section=S, sql="""
SELECT o_orderkey AS ip_id, o_totalprice FROM orders WHERE o_orderstatus = 'P'
""")
def filter_unassigned_sorted(spark, sf_dir):
    """Addresses with no owner (pending orders have none), sorted by id."""
    o = Tables(spark, sf_dir).orders.select(
        F.col("o_orderkey").alias("ip_id"), "o_totalprice",
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("owner"))
    return o.where(F.col("owner").isNull()).orderBy("ip_id").drop("owner")


@query("lookup_unique", section=S, sql="""
SELECT * FROM orders WHERE CAST(o_orderkey AS VARCHAR) = '42'
""")
def lookup_unique(spark, sf_dir):
    """Fetch one row by string id: none -> LookupError, several -> ValueError."""
    return TB.lookup_unique(Tables(spark, sf_dir).orders, "o_orderkey", "42")


@query("lookup_clustered", section=S, sql="""
SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderkey IN (42, 7, 1207, 2000000000)
""")
def lookup_clustered(spark, sf_dir):
    """Rows of some ids from a table laid out by date: row groups without one are skipped
    by their bloom filters."""
    orders = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    laid = save_clustered(orders, scratch_dir(spark, "clustered"), ["o_orderdate", "o_orderkey"], ["o_orderkey"])
    return TB.lookup_points(laid, "o_orderkey", ["42", "7", "1207", "2000000000", "not an id"])


KEY_ID_RE = r"/(\d+)(?:\.html|/)?(?:[?#].*)?$"


@query("extract_named_keys", section=S, sql=f"""
SELECT page_id, regexp_extract(url, '{KEY_ID_RE}', 1) AS key_id FROM pages
WHERE regexp_extract(url, '{KEY_ID_RE}', 1) <> ''
""")
def extract_named_keys(spark, sf_dir):
    """Keys whose last segment is an id; the id extracted, newest (highest) first."""
    p = Tables(spark, sf_dir).pages.select("page_id", "url")
    return TB.extract_named_keys(p, "url", KEY_ID_RE).select("page_id", "key_id").orderBy(F.col("page_id").desc())


@query("compose_split_key", section=S, sql="""
WITH k AS (SELECT o_orderkey,
                  CAST(o_custkey AS VARCHAR) || '__' || coalesce(o_orderpriority, '') || '__'
                  || CAST(o_orderkey AS VARCHAR) AS composed FROM orders),
     s AS (SELECT *, string_split(composed, '__') AS parts FROM k)
SELECT o_orderkey, composed,
       CASE WHEN len(parts) = 3 THEN parts[1] END AS project_id,
       CASE WHEN len(parts) = 3 THEN parts[2] END AS user_id,
       CASE WHEN len(parts) = 3 THEN parts[3] END AS resource_id,
       len(parts) = 3 AS ok
FROM s
""")
def compose_split_key(spark, sf_dir):
    """project__user__resource ids and back; not exactly three parts -> error row (ok = false)."""
    o = Tables(spark, sf_dir).orders
    k = o.select("o_orderkey", TB.compose_key(F.col("o_custkey"), F.col("o_orderpriority"),
                                              F.col("o_orderkey")).alias("composed"))
    parts = TB.split_key(F.col("composed"))
    return k.select("o_orderkey", "composed",
                    F.element_at(parts, 1).alias("project_id"), F.element_at(parts, 2).alias("user_id"),
                    F.element_at(parts, 3).alias("resource_id"), parts.isNotNull().alias("ok"))


@query("name_or_id", section=S, sql=f"""
WITH p AS (SELECT page_id, url, regexp_extract(html, '{TITLE_RE}', 1) AS title FROM pages)
SELECT page_id,
       coalesce(nullif(title, ''), '(' || substring(url, 1, 13) || ')') AS label,
       coalesce(nullif(title, ''), '(' || substring(url, 1, 8) || ')') AS label8,
       coalesce(nullif(title, ''), url) AS label_full
FROM p
""")
def name_or_id(spark, sf_dir):
    """Page title, else '(first 13 chars of id)'; 8-char and whole-id variants."""
    p = Tables(spark, sf_dir).pages.select("page_id", "url", F.regexp_extract("html", TITLE_RE, 1).alias("title"))
    t, u = F.col("title"), F.col("url")
    return p.select("page_id", D.name_or_id(t, u, 13).alias("label"), D.name_or_id(t, u, 8).alias("label8"),
                    D.name_or_id(t, u, None, parens=False).alias("label_full"))


@query("admission_check", section=S, sql=f"""
WITH s AS ({V.SERVERS_SQL}),
     q AS ({V.TENANT_QUOTA_SQL}),
     u AS (SELECT tenant_id, count(*) FILTER (WHERE state = 'active') AS used,
                  count(*) FILTER (WHERE state = 'paused') AS requested FROM s GROUP BY tenant_id),
     a AS (SELECT q.tenant_id, coalesce(u.requested, 0) AS requested,
                  CASE WHEN q.instances_limit IS NULL THEN 'inf'::DOUBLE
                       ELSE greatest(q.instances_limit - coalesce(u.used, 0), 0)::DOUBLE END AS available
           FROM q LEFT JOIN u ON q.tenant_id = u.tenant_id)
SELECT tenant_id, CAST(requested AS BIGINT) AS requested, available,
       requested <= available AS admitted,
       CASE WHEN requested > available THEN
         'requested ' || CAST(requested AS VARCHAR) || ' > available ' || CAST(CAST(available AS BIGINT) AS VARCHAR)
       END AS reason
FROM a
""")
def admission_check(spark, sf_dir):
    """Reject a tenant's request (pending servers) when it exceeds the quota left
    after its active servers; unlimited quota is +inf."""
    from cirrus.operators import quota as QU
    t = Tables(spark, sf_dir)
    s = V.servers(t.orders)
    tally = s.groupBy("tenant_id").agg(F.count_if(F.col("state") == "active").alias("used"),
                                       F.count_if(F.col("state") == "paused").alias("requested"))
    return QU.admission_check(V.tenant_quota(t.customer), tally)


CIDR_SQL = """CASE WHEN l_linenumber = 7
              THEN 'fe80::' || hex(l_partkey) || '/' || CAST(l_partkey % 140 AS VARCHAR)
            WHEN l_linenumber = 6 THEN CAST(l_suppkey % 300 AS VARCHAR) || '/' || CAST(l_partkey % 40 AS VARCHAR)
            ELSE CAST(l_suppkey % 300 AS VARCHAR) || '.' || CAST(l_partkey % 256 AS VARCHAR) || '.0.0/'
                 || CAST(l_linenumber * 6 AS VARCHAR) END"""


@query("row_quality_check", section=S, sql=f"""
WITH r AS (
  SELECT CAST(l_partkey * 37 % 70000 - 3 AS BIGINT) AS port,
         CAST(l_partkey % 700 AS VARCHAR) || CASE l_linenumber WHEN 1 THEN ':' || CAST(l_suppkey * 997 % 70000 AS VARCHAR)
             WHEN 2 THEN ':x' WHEN 3 THEN ':1:2' WHEN 4 THEN '' ELSE ':' || CAST(l_linenumber - 7 AS VARCHAR) END AS port_text,
         CAST(l_quantity AS BIGINT) * 1000 AS lo, CAST(l_quantity AS BIGINT) * 1000 + (l_linenumber - 4) * 100 AS hi,
         CAST(l_suppkey % 300 - 5 AS BIGINT) AS proto,
         {CIDR_SQL} AS cidr
  FROM lineitem),
v AS (
  SELECT port IS NOT NULL AND port BETWEEN -1 AND 65535 AS port_ok,
         len(string_split(port_text, ':')) <= 2 AND coalesce(list_bool_and(list_transform(string_split(port_text, ':'),
             lambda x: coalesce(TRY_CAST(x AS BIGINT) BETWEEN -1 AND 65535, false))), false) AS text_ok,
         lo BETWEEN -1 AND 65535 AND hi BETWEEN -1 AND 65535 AND lo <= hi AS range_ok,
         coalesce(proto BETWEEN -1 AND 255, false) AS proto_ok,
         coalesce(CASE WHEN len(string_split(cidr, '/')) > 2 THEN false
                       WHEN contains(string_split(cidr, '/')[1], ':')
                       THEN regexp_full_match(string_split(cidr, '/')[1], '{Q.V6}')
                            AND (len(string_split(cidr, '/')) = 1
                                 OR (regexp_full_match(string_split(cidr, '/')[2], '[0-9]{{1,3}}')
                                     AND TRY_CAST(string_split(cidr, '/')[2] AS INTEGER) BETWEEN 0 AND 128))
                       ELSE regexp_full_match(string_split(cidr, '/')[1], '{Q.V4_SHORT}')
                            AND (len(string_split(cidr, '/')) = 1
                                 OR (regexp_full_match(string_split(cidr, '/')[2], '[0-9]{{1,3}}')
                                     AND TRY_CAST(string_split(cidr, '/')[2] AS INTEGER) BETWEEN 0 AND 32)) END,
                  false) AS cidr_ok
  FROM r)
SELECT 'port' AS rule, CAST(count(*) FILTER (WHERE port_ok) AS BIGINT) AS n_pass,
       CAST(count(*) FILTER (WHERE NOT port_ok) AS BIGINT) AS n_fail FROM v
UNION ALL SELECT 'port_text', count(*) FILTER (WHERE text_ok), count(*) FILTER (WHERE NOT text_ok) FROM v
UNION ALL SELECT 'port_range', count(*) FILTER (WHERE range_ok), count(*) FILTER (WHERE NOT range_ok) FROM v
UNION ALL SELECT 'protocol', count(*) FILTER (WHERE proto_ok), count(*) FILTER (WHERE NOT proto_ok) FROM v
UNION ALL SELECT 'cidr', count(*) FILTER (WHERE cidr_ok), count(*) FILTER (WHERE NOT cidr_ok) FROM v
""")
def row_quality_check(spark, sf_dir):
    """Port (a number, and 'a' or 'a:b' as text), port-range, protocol and CIDR (IPv4 incl. short forms, or IPv6;
    mask within the version's range) rules over derived rule rows; pass and
    fail counts per rule from one aggregate."""
    from cirrus.operators.jobs import spread
    li = spread(Tables(spark, sf_dir).lineitem.select("l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                                      "l_returnflag"))
    ln, pk, sk = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    cidr = (F.when(ln == 7, F.concat(F.lit("fe80::"), F.hex(pk), F.lit("/"), (pk % 140).cast("string")))
            .when(ln == 6, F.concat((sk % 300).cast("string"), F.lit("/"), (pk % 40).cast("string")))
            .otherwise(F.concat((sk % 300).cast("string"), F.lit("."), (pk % 256).cast("string"), F.lit(".0.0/"),
                                (ln * 6).cast("string"))))
    r = li.select(
        (pk * 37 % 70000 - 3).cast("bigint").alias("port"),
        F.concat((pk % 700).cast("string"), F.when(ln == 1, F.concat(F.lit(":"), (sk * 997 % 70000).cast("string")))
                 .when(ln == 2, ":x").when(ln == 3, ":1:2").when(ln == 4, "")
                 .otherwise(F.concat(F.lit(":"), (ln - 7).cast("string")))).alias("port_text"),
        (F.col("l_quantity").cast("bigint") * 1000).alias("lo"),
        (F.col("l_quantity").cast("bigint") * 1000 + (ln - 4) * 100).alias("hi"),
        (sk % 300 - 5).cast("bigint").alias("proto"),
        cidr.alias("cidr"))
    rules = {"port": Q.valid_port(F.col("port")), "port_text": Q.valid_port_text(F.col("port_text")),
             "port_range": Q.valid_port_range(F.col("lo"), F.col("hi")),
             "protocol": Q.valid_protocol(F.col("proto")),
             "cidr": Q.valid_ip(F.col("cidr"), Q.IPV4 | Q.IPV6, mask=True)}
    return Q.rule_counts(r, rules)
