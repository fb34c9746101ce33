"""Substring and wildcard filters that read only part of a table: trigram postings.

A table is written in groups of rows (files in order of some columns), beside a table of
postings: which groups hold a trigram in a column. A term's trigrams, all of which a
matching cell must hold, select the groups; Spark prunes the scan to them by dynamic
partition pruning and the exact filter is applied to their rows. The groups are a
superset of what matches, so the rows are those of a full scan. Terms of under three
characters select nothing and scan everything.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirrus.operators import table as TB

#: Groups of rows; the list of groups that a term selects is no longer.
GROUPS = 256


def grams(piece: str) -> set[str]:
    """The trigrams of a piece of text, in lower case."""
    low = piece.lower()
    return {low[i:i + 3] for i in range(len(low) - 2)}


def _grams_of(cell: Column) -> Column:
    """A cell's distinct trigrams, in time linear in its length; null cells have none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(cell.cast("string")), F.lit(r"(?s)(?=(...))"), F.lit(1)))


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    path: str
    schema: T.StructType        # of the rows; the group is one column more

    def rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("grp", T.IntegerType())])).parquet(f"{self.path}/rows")

    def _groups(self, column: str, wanted: set[str]) -> DataFrame:
        """Groups that hold every trigram somewhere in the column."""
        held = (self.spark.read.schema("gram string, at int, of string").parquet(f"{self.path}/postings")
                .where((F.col("of") == column) & F.col("gram").isin(sorted(wanted))))
        return held.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("at")

    def _filtered(self, wanted: Sequence[tuple[str, set[str]]], exact: Callable[[DataFrame], DataFrame]) -> DataFrame:
        rows = self.rows()
        if not all(g for _, g in wanted):        # a piece without trigrams may be anywhere
            return exact(rows).drop("grp")
        groups = reduce(DataFrame.unionByName, [self._groups(c, g) for c, g in wanted]).distinct()
        # at most as many rows as there are groups: a proven bound for the broadcast
        met = rows.join(F.broadcast(groups), F.col("grp") == F.col("at"), "left_semi")
        return exact(met).drop("grp")

    def contains_any(self, columns: Sequence[str], *terms: str) -> DataFrame:
        """Rows of which one of the columns contains one of the terms (any case); null cells don't."""
        holds = reduce(lambda a, b: a | b, [TB.contains_ci(F.col(c), q) for q in terms for c in columns])
        return self._filtered([(c, grams(q)) for q in terms for c in columns], lambda df: df.where(holds))

    def wildcard(self, column: str, filter_string: str) -> DataFrame:
        """Rows whose column matches the first term's pieces in their order."""
        term = filter_string.lower().strip().split(" ")[0]
        wanted = set().union(*(grams(p) for p in term.split("*")))
        return self._filtered([(column, wanted)], lambda df: TB.filter_wildcard(df, column, filter_string))


def build(df: DataFrame, columns: Sequence[str], order: Sequence[str], path: str, groups: int = GROUPS) -> TextIndex:
    """Write ``df`` in ``groups`` ranges of ``order`` (end it with a unique column, so that
    equal values may be parted; similar texts next to each other prune best) and the
    postings of ``columns``, in order of the trigrams. A trigram that every row holds is
    combined map-side to one posting a group. ``df`` must have no column ``grp``."""
    if "grp" in df.columns:
        raise ValueError("the table has a column named grp already")
    spark = df.sparkSession
    (df.repartitionByRange(groups, *order).withColumn("grp", F.spark_partition_id())
     .write.mode("overwrite").partitionBy("grp").parquet(f"{path}/rows"))
    index = TextIndex(spark, path, df.schema)
    rows = index.rows()
    each = [rows.select(F.explode(_grams_of(F.col(c))).alias("gram"), F.col("grp").alias("at"), F.lit(c).alias("of")) for c in columns]
    postings = reduce(DataFrame.unionByName, each).distinct()
    (postings.repartitionByRange("of", "gram", "at").sortWithinPartitions("gram", "at")
     .write.mode("overwrite").partitionBy("of").parquet(f"{path}/postings"))
    return index
