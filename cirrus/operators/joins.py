"""Join helpers: lookup enrichment, semi and anti joins.

No side is hinted: the planner broadcasts a dimension whose size it knows to be
below ``spark.sql.autoBroadcastJoinThreshold``, AQE does so when a side turns out
that small at run time, and skewed partitions of the larger side are split. So
building a query starts no job and no size is remembered from an earlier run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(fact: DataFrame, dim: DataFrame, on: str | Sequence[str] | Column, how: str = "left") -> DataFrame:
    """Enrich ``fact`` with ``dim`` columns."""
    return fact.join(dim, on, how)


def label_or_id(label: Column, key: Column) -> Column:
    """Failed lookup shows the id as text; a null id stays null."""
    return F.when(key.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(label, key.cast("string")))


def _keys(right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    cols = [on] if isinstance(on, str) else list(on)
    # distinct is a partial aggregate: a key repeated by a third of the rows
    # collapses map-side to one row per task before the shuffle
    return right.select(*cols).distinct()


def semi_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``left`` with a match in ``right`` (EXISTS). The right side is
    reduced to its distinct keys first, so a hot key on the probe side never
    builds one huge partition; the left side stays splittable by AQE."""
    return left.join(_keys(right, on), on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a match in ``right`` (NOT EXISTS), right side
    reduced to distinct keys as in :func:`semi_join`."""
    return left.join(_keys(right, on), on, "left_anti")
