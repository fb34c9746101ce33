"""A key holding a third of the rows: joins are split by AQE, aggregates and
semi joins collapse it map-side, and results stay whole."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from cirrus.operators.joins import lookup, semi_join

SKEW_CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def hot(spark, n=300_000):
    return spark.range(0, n).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"),
                                    (F.col("id") * 2).alias("v"))


def test_hot_key_join_is_split(spark, skew_conf):
    left = hot(spark)
    dim = spark.range(0, 300_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("name"))
    j = lookup(left, dim, "k")          # above the broadcast threshold: sort-merge join
    rows = j.collect()
    assert len(rows) == 300_000 and sum(1 for r in rows if r["k"] == 7) == 100_001
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        j.explain()
    assert "SortMergeJoin(skew=true)" in buf.getvalue()


def test_hot_key_semi_join_and_aggregate(spark, skew_conf):
    right = hot(spark)
    keys = spark.range(0, 20).select(F.col("id").alias("k"))
    assert sorted(r["k"] for r in semi_join(keys, right, "k").collect()) == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14, 16, 17, 19]
    agg = right.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("k") == 7).first()
    assert agg["n"] == 100_001          # every third row, plus id 7 itself
