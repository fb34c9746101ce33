"""Pages of a large ordered table by a sparse key index.

The rows are written in ranges of the sort keys, a folder each; the index has a row for
each range: its first and last keys, its number of rows and how many come before it. A
page (after a marker, before one, or by its number) finds its ranges in the index, and
dynamic partition pruning reads only those: two, if a range holds a page and one row more,
however deep the page is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirrus.operators import table as TB


@dataclass(frozen=True)
class PageIndex:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: T.StructType        # of the rows; the range's number is one column more

    def rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("grp", T.IntegerType())])).parquet(f"{self.path}/rows")

    def index(self) -> DataFrame:
        """(at, first, last, n, before), a row for each range."""
        return self.spark.read.parquet(f"{self.path}/index")

    def _only(self, ranges: DataFrame) -> DataFrame:
        # no more rows than there are ranges: a proven bound for the broadcast
        return self.rows().join(F.broadcast(ranges.select("at")), F.col("grp") == F.col("at"), "left_semi").drop("grp")

    def around(self, marker: Sequence | None, page_size: int, backward: bool = False) -> DataFrame:
        """The page after the row whose keys are ``marker`` (or before it; without one the
        first or last page), as :func:`cirrus.operators.table.page_around_marker` gives it."""
        ranges = self.index()
        if marker is not None:
            at = F.struct(*[F.lit(m).cast(self.schema[k].dataType).alias(k) for k, m in zip(self.keys, marker)])
            ranges = ranges.where(F.col("first") < at if backward else F.col("last") > at)
        # the nearest range may have no more than one row beyond the marker; those
        # behind it are taken until they hold a page and a row. The index is small
        order = F.col("at").desc() if backward else F.col("at")
        nearer = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        taken = (ranges.withColumn("nearer", F.coalesce(F.sum("n").over(nearer), F.lit(0)))
                 .withColumn("nearest", F.first("n").over(Window.orderBy(order)))
                 .where(F.col("nearer") - F.col("nearest") <= page_size))
        return TB.page_around_marker(self._only(taken), self.keys, marker, page_size, backward)

    def numbered(self, number: int, page_size: int) -> DataFrame:
        """Page ``number`` (from 0) with the rows' positions in the whole order."""
        low, high = number * page_size, (number + 1) * page_size
        ranges = self.index().where((F.col("before") < high) & (F.col("before") + F.col("n") > low)).select("at", "before")
        met = self.rows().join(F.broadcast(ranges), F.col("grp") == F.col("at"))
        position = F.row_number().over(Window.partitionBy("grp").orderBy(*self.keys)) - 1 + F.col("before")
        return (met.withColumn("position", position).where(F.col("position").between(low, high - 1))
                .drop("grp", "at", "before").orderBy("position"))


def build(df: DataFrame, keys: Sequence[str], path: str, ranges: int) -> PageIndex:
    """Write ``df`` in ``ranges`` ranges of ``keys`` (together unique, without nulls) and
    their index. ``df`` must have no column ``grp``."""
    if "grp" in df.columns:
        raise ValueError("the table has a column named grp already")
    (df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("grp", F.spark_partition_id())
     .write.mode("overwrite").partitionBy("grp").parquet(f"{path}/rows"))
    out = PageIndex(df.sparkSession, path, tuple(keys), df.schema)
    key: Column = F.struct(*keys)
    cells = out.rows().groupBy(F.col("grp").alias("at")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)     # a row for each range
    cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    return out
