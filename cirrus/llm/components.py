"""Connected components of a link table, as joins and groupings.

Alternating stars: the large star links every larger neighbour of a node to the
smallest node it knows, the small star does so for the smaller neighbours. After
a few rounds (logarithmic in the longest path) every component is a star around
its smallest node. Each round is a written table, the one before is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.llm.storage import drop_table, write_table


def _with_smallest(links: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest v of u. Both sides of the join are keyed by an
    expression of their own, so that neither inherits the grouping's partitioning
    and AQE can split the links of a node that has very many."""
    smallest = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    return links.join(smallest, F.bitwise_not("u") == F.bitwise_not("k")).drop("k")


def _round(links: DataFrame) -> DataFrame:
    """One large star, then one small star. ``links`` are (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (_with_smallest(both).where("v > u")
             .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct())
    met = _with_smallest(large)
    return (met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                         F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*").where("u <> v").distinct())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link to another; component is
    the smallest node reachable. Ids are longs; null ends, loops and repeated
    links are ignored. An empty table gives an empty result."""
    spark = links.sparkSession
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    state, path = write_table(
        links.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links")
    seen = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen, old = mark, path
        state, path = write_table(_round(state), "links")
        drop_table(spark, old)
