"""Metering statistics over a samples table ``(ts, meter, resource, volume, ...)``.

Statistics are hash aggregates keyed by (resource, meter[, bucket]): partial
aggregation runs before the shuffle, so a resource holding a third of all
samples ships one partial row per map task and bucket. Buckets are fixed-size
periods counted from an origin (the query's lower bound), computed on the
microsecond clock, so batch and streaming forms agree.

``avg`` is computed as ``round(sum, 2) / count``: the sum of 2-decimal volumes
rounded back to 2 decimals is exact, so the mean does not depend on the order
in which partial sums were combined.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.operators.enrich import bounded, collect_list

STAT_NAMES = ("count", "min", "max", "sum", "avg", "duration_start", "duration_end")


def _stats(volume: str, ts: str) -> list[Column]:
    s = F.round(F.sum(volume), 2)
    return [F.count(F.lit(1)).alias("count"), F.min(volume).alias("min"), F.max(volume).alias("max"),
            s.alias("sum"), (s / F.count(F.lit(1))).alias("avg"),
            F.min(ts).alias("duration_start"), F.max(ts).alias("duration_end")]


def stats_whole_range(samples: DataFrame, keys: Sequence[str], volume: str = "volume", ts: str = "ts") -> DataFrame:
    """One statistic per key group over the whole range."""
    return samples.groupBy(*keys).agg(*_stats(volume, ts))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def bucket_index(ts: Column, origin: dt.datetime, period_s: int) -> Column:
    """Whole periods elapsed since ``origin`` (samples before it get negative indexes)."""
    o = F.lit(origin).cast("timestamp_ntz")
    return F.floor((_micros(ts) - _micros(o)) / F.lit(period_s * 1_000_000)).cast("bigint")


def stats_by_period(samples: DataFrame, keys: Sequence[str], period_s: int, origin: dt.datetime,
                    volume: str = "volume", ts: str = "ts") -> DataFrame:
    """Statistics per fixed period; periods without samples are absent.
    ``period_start``/``period_end`` bound the bucket, ``duration_*`` are the
    first/last sample times inside it."""
    o = F.lit(origin).cast("timestamp_ntz")
    b = samples.withColumn("_bucket", bucket_index(F.col(ts), origin, period_s))
    agg = b.groupBy(*keys, "_bucket").agg(*_stats(volume, ts))
    start = F.timestamp_add("SECOND", F.col("_bucket") * F.lit(period_s), o)
    return agg.select(*keys, start.alias("period_start"),
                      F.timestamp_add("SECOND", F.lit(period_s), start).alias("period_end"),
                      F.lit(period_s).cast("bigint").alias("period"), *STAT_NAMES)


def select_attr(stats: DataFrame, keys: Sequence[str], attr: str) -> DataFrame:
    """Keep one attribute of the statistic (null when there is none)."""
    if attr not in STAT_NAMES:
        raise ValueError(f"unknown statistic attribute {attr!r}")
    return stats.select(*keys, F.col(attr).alias(attr))


def meter_column_name(meter: str) -> str:
    return meter.replace(".", "_")


def meters_wide(samples: DataFrame, key: str, meter: str, meters: Sequence[str], attr: str = "avg",
                volume: str = "volume", ts: str = "ts") -> DataFrame:
    """One column per meter (``.`` -> ``_``) holding the chosen statistic.
    ``meters`` is the explicit pivot list (no extra distinct job)."""
    stats = samples.groupBy(key, meter).agg(*_stats(volume, ts))
    wide = stats.groupBy(key).pivot(meter, list(meters)).agg(F.first(attr))
    return wide.select(key, *[F.col(f"`{m}`").alias(meter_column_name(m)) for m in meters])


def series_points(period_stats: DataFrame, key: str, attr: str = "avg") -> DataFrame:
    """Per resource the chart points ``(x = first 19 chars of duration_end, y)``
    in time order. Over the range that ``period_from_range`` was given there are about
    400 of them; a longer series is bounded by ``enrich.MAX_LIST``."""
    pts = period_stats.select(key, F.struct(
        F.substring(F.date_format("duration_end", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 1, 19).alias("x"),
        F.col(attr).cast("double").alias("y")).alias("pt"))
    return bounded(pts, key).groupBy(key).agg(F.sort_array(collect_list(F.col("pt"))).alias("points"))
