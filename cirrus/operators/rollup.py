"""A rollup pyramid over samples: mergeable statistics at several resolutions.

A query for periods of any length and origin takes, for each period, the coarsest
cells that lie within it and raw samples only where a finest cell crosses a period's
border. Cells nest, so each sample is counted through one cell exactly. The raw
samples are stored in order of their finest cell; the few border cells are pushed
down as a list, so that other row groups are not read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrus.operators.metering import STAT_NAMES

#: Seconds of a cell at each level; each divides the next.
LEVELS = (60, 3600, 86400)
#: Borders whose cells are pushed down as a list; a chart has some 400 periods.
MOST_BORDERS = 4000
_EPOCH = dt.datetime(1970, 1, 1)
_PARTIAL = ["count", "min", "max", "sum_raw", "first_us", "last_us"]


@dataclass(frozen=True)
class Pyramid:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    levels: tuple[int, ...]

    def level(self, seconds: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/level={seconds}")

    def raw(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/raw")


def _merged() -> list[Column]:
    return [F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum_raw").alias("sum_raw"),
            F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")]


def _as_partial(volume: str) -> list[Column]:
    return [F.lit(1).cast("long").alias("count"), F.col(volume).alias("min"), F.col(volume).alias("max"), F.col(volume).alias("sum_raw"),
            F.col("us").alias("first_us"), F.col("us").alias("last_us")]


def build(samples: DataFrame, keys: Sequence[str], path: str, ts: str = "ts", volume: str = "volume",
          levels: Sequence[int] = LEVELS) -> Pyramid:
    """Write the pyramid of ``samples``: the raw rows by their finest cell, and every
    level from the one below. A hot key is combined map-side at each level. Samples
    without a time are left out."""
    if any(b % a for a, b in zip(levels, levels[1:])):
        raise ValueError("each level must divide the next")
    spark, keys = samples.sparkSession, list(keys)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    raw = samples.where(F.col(ts).isNotNull()).select(*keys, us.alias("us"), F.col(volume).alias("volume"),
                                                      F.floor(us / (levels[0] * 1_000_000)).cast("long").alias("cell"))
    raw.repartitionByRange(F.col("cell"), *keys).sortWithinPartitions("cell").write.parquet(f"{path}/raw")
    below = spark.read.schema(raw.schema).parquet(f"{path}/raw").select(*keys, "cell", *_as_partial("volume"))
    step = 1
    for i, seconds in enumerate(levels):
        cells = below.withColumn("cell", F.floor(F.col("cell") / step).cast("long")).groupBy(*keys, "cell").agg(*_merged())
        cells.write.parquet(f"{path}/level={seconds}")
        below = spark.read.schema(cells.schema).parquet(f"{path}/level={seconds}")
        step = levels[i + 1] // seconds if i + 1 < len(levels) else 1
    return Pyramid(spark, path, tuple(keys), tuple(levels))


def _micros(t: dt.datetime) -> int:
    return (t - _EPOCH) // dt.timedelta(microseconds=1)


def stats_by_period(pyramid: Pyramid, period_s: int, origin: dt.datetime, until: dt.datetime | None = None) -> DataFrame:
    """As :func:`cirrus.operators.metering.stats_by_period` over the samples from
    ``origin`` on (before ``until``), answered from the pyramid."""
    low, period = _micros(origin), period_s * 1_000_000
    if until is None:
        top = pyramid.levels[-1]
        last = pyramid.level(top).agg(F.max("cell")).first()[0]
        high = low if last is None else max(low, (last + 1) * top * 1_000_000)
    else:
        high = _micros(until)

    def bucket(us: Column | int) -> Column:
        return F.floor(((F.lit(us) if isinstance(us, int) else us) - F.lit(low)) / F.lit(period)).cast("long")

    def within(cell: Column, seconds: int) -> Column:
        begin, end = cell * (seconds * 1_000_000), (cell + 1) * (seconds * 1_000_000) - 1
        return (begin >= low) & (end < high) & (bucket(begin) == bucket(end))

    taken, keys = [], list(pyramid.keys)
    for i, seconds in enumerate(pyramid.levels):
        unit = seconds * 1_000_000
        cells = pyramid.level(seconds).where(F.col("cell").between(low // unit, high // unit) & within(F.col("cell"), seconds))
        if i + 1 < len(pyramid.levels):
            wider = pyramid.levels[i + 1]
            cells = cells.where(~within(F.floor(F.col("cell") / (wider // seconds)).cast("long"), wider))
        taken.append(cells.select(*keys, bucket(F.col("cell") * unit).alias("_bucket"), *_PARTIAL))
    fine = pyramid.levels[0] * 1_000_000
    if low % fine or period % fine or high % fine:      # else no finest cell crosses a border
        raw = pyramid.raw().where((F.col("us") >= low) & (F.col("us") < high) & ~within(F.col("cell"), pyramid.levels[0]))
        if (high - low) // period <= MOST_BORDERS:
            borders = {b // fine for b in [*range(low, high, period), high] if b % fine}
            raw = raw.where(F.col("cell").isin(sorted(borders)))
        taken.append(raw.select(*keys, bucket(F.col("us")).alias("_bucket"), *_as_partial("volume")))
    merged = reduce(DataFrame.unionByName, taken).groupBy(*keys, "_bucket").agg(*_merged())
    start = F.timestamp_add("SECOND", F.col("_bucket") * F.lit(period_s), F.lit(origin).cast("timestamp_ntz"))
    total = F.round("sum_raw", 2)
    stats = {"count": F.col("count"), "min": F.col("min"), "max": F.col("max"), "sum": total, "avg": total / F.col("count"),
             "duration_start": F.timestamp_micros("first_us").cast("timestamp_ntz"),
             "duration_end": F.timestamp_micros("last_us").cast("timestamp_ntz")}
    return merged.select(*keys, start.alias("period_start"), F.timestamp_add("SECOND", F.lit(period_s), start).alias("period_end"),
                         F.lit(period_s).cast("bigint").alias("period"), *[stats[c].alias(c) for c in STAT_NAMES])
