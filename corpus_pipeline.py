"""The corpus pipeline: quality, repeated passages, near copies, benchmark leaks, ids.

``STAGES`` are applied in order to ``documents``; each stage's rows are written as
Parquet and read again as the next one's. All but the last return the columns of
``documents``, with their decisions applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrus.llm import bpe, decontaminate, line_dedup, quality, simhash
from cirrus.llm.storage import write_table
from cirrus.operators.jobs import spread
from cirrus.sources.tables import load


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labelled ones among them,
    scores below a half go."""
    return quality.keep_good(docs, quality.learn(docs, load(spark, sf_dir, "labels")))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds leave the text (n_chars follows it);
    documents of which nothing is left go."""
    cut = F.col("lines_removed") > 0
    done = line_dedup.remove_shared(docs).where(~(cut & (F.trim("text") == "")))
    return done.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash class the document with the smallest doc_id stays, once if its
    row is repeated. Rows without a doc_id stay."""
    classes = simhash.near_duplicates(docs)
    leave = classes.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = (docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
                .join(leave, "doc_id", "left_anti"))
    once = docs.join(leave.unionByName(repeated), "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaking(docs, decontaminate.find_leaks(docs, load(spark, sf_dir, "benchmark")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids and their decoded bytes, as digests."""
    done = bpe.round_trip(docs)
    return done.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality_filter), ("line_dedup", passage_dedup), ("simhash", near_dedup),
          ("decontamination", decontamination), ("bpe", token_ids)]

#: Hashing, training and the BPE merges have no SQL form; tests hold run() against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spread(load(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs, _ = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
