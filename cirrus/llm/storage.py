"""Intermediate tables in the shared folder (``spark.checkpoint.dir``).

A written table cuts the lineage and survives lost executors. Paths are only
ever touched through Spark or Hadoop's file systems, so any store works.
"""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from cirrus.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is created."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet below the shared folder, partitioned by a column if one
    is given, and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of jobs that nothing refers to any
    more. It learns of them when the driver's garbage is collected, which may be late;
    what the first collection frees may hold more, and the cleaner works beside."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table made by :func:`write_table` once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
