"""Operations concepts mapped onto the shared tables (see FIXTURES.md section 3).

Each view exists twice: a Spark builder used by the queries, and the same
definition as a SQL fragment the oracle strings embed, so both engines start
from identical inputs. Attribute derivations (sizes from key arithmetic) are
row-local expressions; none of them filters rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- servers: one usage record per order ------------------------------------------------

SERVERS_SQL = """
SELECT o_orderkey AS server_id,
       o_custkey AS tenant_id,
       'server-' || CAST(o_orderkey AS VARCHAR) AS name,
       CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'deleted' ELSE 'paused' END AS state,
       CAST(1 + o_orderkey % 8 AS INTEGER) AS vcpus,
       CAST(512 * (1 + o_orderkey % 16) AS INTEGER) AS memory_mb,
       CAST(10 * (1 + o_orderkey % 10) AS INTEGER) AS local_gb,
       floor(o_totalprice / 10.0) / 100.0 AS hours,
       CAST(floor(o_totalprice) AS BIGINT) AS uptime,
       o_orderdate AS started_at,
       CASE WHEN o_orderstatus = 'O' THEN NULL
            ELSE o_orderdate + to_seconds(CAST(floor(o_totalprice) AS BIGINT)) END AS ended_at,
       o_orderpriority AS priority
FROM orders
"""


def servers(orders: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Server usage records; ``keep`` passes source columns through (so callers
    never re-join orders to itself for them)."""
    k = F.col("o_orderkey")
    uptime = F.col("o_totalprice").cast("bigint")
    return orders.select(
        k.alias("server_id"),
        F.col("o_custkey").alias("tenant_id"),
        F.concat(F.lit("server-"), k.cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "O", "active")
         .when(F.col("o_orderstatus") == "F", "deleted").otherwise("paused").alias("state"),
        (F.lit(1) + k % 8).cast("int").alias("vcpus"),
        (F.lit(512) * (F.lit(1) + k % 16)).cast("int").alias("memory_mb"),
        (F.lit(10) * (F.lit(1) + k % 10)).cast("int").alias("local_gb"),
        (F.floor(F.col("o_totalprice") / 10.0) / 100.0).alias("hours"),
        uptime.alias("uptime"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None))
         .otherwise(F.timestamp_add("SECOND", uptime, F.col("o_orderdate"))).alias("ended_at"),
        F.col("o_orderpriority").alias("priority"),
        *keep,
    )


# --- flavors: one per part ---------------------------------------------------------------

FLAVORS_SQL = """
SELECT p_partkey AS flavor_id, p_name AS flavor_name,
       CAST(1 + p_size % 8 AS INTEGER) AS vcpus,
       CAST(512 * (1 + p_size % 16) AS INTEGER) AS ram,
       CAST(10 * p_size AS INTEGER) AS disk
FROM part
"""


def flavors(part: DataFrame) -> DataFrame:
    s = F.col("p_size")
    return part.select(
        F.col("p_partkey").alias("flavor_id"),
        F.col("p_name").alias("flavor_name"),
        (F.lit(1) + s % 8).cast("int").alias("vcpus"),
        (F.lit(512) * (F.lit(1) + s % 16)).cast("int").alias("ram"),
        (F.lit(10) * s).cast("int").alias("disk"),
    )


# --- tenants: one per customer, quotas derived from the account balance ------------------

TENANT_QUOTA_SQL = """
SELECT c_custkey AS tenant_id, c_name AS tenant_name,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_acctbal / 500) AS BIGINT) END AS instances_limit
FROM customer
"""


def tenant_quota(customer: DataFrame) -> DataFrame:
    """Instance quota per tenant; a negative balance means unlimited (None)."""
    return customer.select(
        F.col("c_custkey").alias("tenant_id"),
        F.col("c_name").alias("tenant_name"),
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("bigint"))
         .otherwise(F.floor(F.col("c_acctbal") / 500).cast("bigint")).alias("instances_limit"),
    )


# --- keys without a record: ids outside the dimension's range, so lookups miss ------------

#: Above every id of the test tables.
GONE = 1_000_000_000
PART_KEY_SQL = f"(l.l_partkey + CASE WHEN l.l_linenumber = 7 THEN {GONE} ELSE 0 END)"
VOLUME_KEY_SQL = f"(l.l_orderkey + CASE WHEN l.l_linenumber = 7 THEN {GONE} ELSE 0 END)"
POOL_KEY_SQL = "(s.s_nationkey + CASE WHEN s.s_suppkey % 10 = 0 THEN 100 ELSE 0 END)"


def part_key():
    """A line's part; a seventh line's is in no catalogue."""
    return F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, GONE).otherwise(0)


def volume_key():
    """A line's order as its volume; a seventh line's is gone."""
    return F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, GONE).otherwise(0)


def pool_key():
    """A supplier's nation as its pool; every tenth supplier's has no record."""
    return F.col("s_nationkey") + F.when(F.col("s_suppkey") % 10 == 0, 100).otherwise(0)
