"""File sources and sinks: typed records, JSON metadata, object listings, text,
CSV reports and JSON series. Writers target folders under the shared checkpoint
root (``cirrus.session.scratch_dir``), never a machine-local temp dir."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_typed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Records with a declared attribute list: only declared fields are read;
    a declared field missing from the files comes back as a null column."""
    return spark.read.schema(schema).format(fmt).load(path).select(*[f.name for f in schema.fields])


def read_json_meta(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON metadata objects under a prefix (one object per line), with a schema."""
    return spark.read.schema(schema).json(path)


def parse_json_meta(col: str, schema: T.StructType | str):
    """In-table form: parse a JSON text column with a declared schema."""
    return F.from_json(F.col(col), schema)


def list_objects(spark: SparkSession, prefix: str, glob: str | None = None) -> DataFrame:
    """Objects under a prefix as (name, bytes, last_modified). Uses the
    binaryFile source without its ``content`` column, so only file metadata
    is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(prefix)
    base = prefix.rstrip("/") + "/"
    name = F.regexp_replace(F.col("path"), "^.*?" + base.split(":", 1)[-1].replace(".", "\\."), "")
    return df.select(name.alias("name"), F.col("length").alias("bytes"),
                     F.col("modificationTime").alias("last_modified"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files (column ``value``); only a line feed ends a line."""
    return spark.read.option("lineSep", "\n").text(path)


def write_text(df: DataFrame, col: str, path: str) -> str:
    df.select(F.col(col).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)
    return path


def write_csv_report(df: DataFrame, path: str, header: bool = True) -> str:
    """CSV, UTF-8, optional header row; one file per partition (no single-task funnel)."""
    df.write.mode("overwrite").option("header", str(header).lower()).option("encoding", "UTF-8").csv(path)
    return path


def read_csv_report(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", str(header).lower()).csv(path)


def write_json_lines(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table bucketed and sorted by ``key``. Two tables bucketed
    the same way on their join key join without a shuffle (sort-merge join on
    co-located buckets), which is how repeated fact-to-fact joins (orders with
    line items) avoid re-shuffling 100 TB each time."""
    w = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
    return df.sparkSession.table(table)


def write_partitioned(df: DataFrame, path: str, by: str, fmt: str = "parquet") -> str:
    """``partitionBy(by)`` without the small-files blow-up and without a hot value
    in one task: rows are rebalanced by the value first, so small values share a
    task and one with very many rows is split into as many tasks as its bytes need
    (AQE's advisory partition size)."""
    writer = df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).format(fmt)
    (writer.option("lineSep", "\n") if fmt == "text" else writer).save(path)
    return path


def save_clustered(df: DataFrame, path: str, by: Sequence[str], lookups: Sequence[str], files: int | None = None,
                   group_rows: int = 1_000_000) -> DataFrame:
    """Write ``df`` in ranges of ``by`` (sorted within a file) with a Parquet bloom filter on
    each column of ``lookups``, and read it back. A range of ``by`` skips row groups and
    pages by their bounds, a point look-up on another column row groups by their bloom
    filters (or dictionaries), so neither reads the whole table. The filters' size follows the values."""
    parts = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    writer = (parts.sortWithinPartitions(*by).write.mode("overwrite")
              .option("parquet.block.row.count.limit", str(group_rows))
              .option("parquet.bloom.filter.adaptive.enabled", "true"))
    for column in lookups:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
