"""Set operations by column name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_typed(frames: Mapping[str, DataFrame], tag: str = "row_type") -> DataFrame:
    """Concatenate row types by column name (missing columns null), tagged."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_all(*frames: DataFrame) -> DataFrame:
    """Concatenate without dedupe."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_if_absent(listed: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``listed`` plus the rows of ``extra`` whose key is not listed yet."""
    from cirrus.operators.joins import anti_join
    return listed.unionByName(anti_join(extra, listed, list(keys)))


def merge_defaults(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Keyed merge: the first set's value wins unless it is null."""
    a = first.select(F.col(key).alias("_k1"), F.col(value).alias("_v1"))
    b = second.select(F.col(key).alias("_k2"), F.col(value).alias("_v2"))
    j = a.join(b, F.col("_k1") == F.col("_k2"), "full_outer")
    return j.select(F.coalesce("_k1", "_k2").alias(key), F.coalesce("_v1", "_v2").alias(value))


def except_both(want: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, change): 'add' (wanted, not current), 'remove' (current, not wanted)
    and one 'union_size' row. One full outer join of the two distinct key sets
    gives all three: both sides are already hash-partitioned by the key after
    their distinct, so the join adds no shuffle, and the union size is a global
    count over the same joined rows (its exchange is reused)."""
    a = want.select(F.col(key).alias("_w")).distinct()
    b = current.select(F.col(key).alias("_c")).distinct()
    j = a.join(b, F.col("_w") == F.col("_c"), "full_outer")
    changes = j.where(F.col("_w").isNull() | F.col("_c").isNull()).select(
        F.coalesce("_w", "_c").alias(key), F.when(F.col("_c").isNull(), "add").otherwise("remove").alias("change"))
    size = j.agg(F.count(F.lit(1)).alias(key)).withColumn("change", F.lit("union_size"))
    return changes.unionByName(size)


def remove_by_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.where(~F.col(col).startswith(prefix))
