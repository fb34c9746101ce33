"""Structured Streaming versions of the polling behaviours.

Every stream checkpoints under the shared checkpoint root and writes through
``foreachBatch`` with an idempotent sink: a micro-batch writes (or replaces) its
own ``batch=<id>`` folder, so a batch replayed after a failure overwrites what
its first attempt left instead of duplicating it. Current tables (latest rows, period
statistics) are kept in a compacted log (``merge_log``) and folded on read.

``run_available_now`` drives a stream over everything currently in its source
and stops: the batch twin of each stream is what it must equal.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cirrus.session import dir_exists, remove_dir, scratch_dir
from cirrus.streaming.merge_log import MergeLog

BatchFn = Callable[[DataFrame, int], None]


def run_available_now(stream: DataFrame, on_batch: BatchFn, checkpoint: str,
                      output_mode: str = "append", timeout_s: float | None = None) -> StreamingQuery:
    """Process all available input in micro-batches, then stop."""
    q = (stream.writeStream.outputMode(output_mode).foreachBatch(on_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    if q.exception() is not None:
        raise q.exception()
    return q


def start_polling(stream: DataFrame, on_batch: BatchFn, checkpoint: str, every: str,
                  output_mode: str = "append") -> StreamingQuery:
    """Run continuously, one micro-batch per interval (the polling cadence of the
    source behaviour: rows refresh every 2.5 s, the job queue every 5 s, logs every
    3 s). Returns the running query; the caller stops it."""
    return (stream.writeStream.outputMode(output_mode).foreachBatch(on_batch)
            .option("checkpointLocation", checkpoint).trigger(processingTime=every).start())


# Polling intervals of the source behaviours.
ROW_REFRESH_EVERY = "2500 milliseconds"
JOB_QUEUE_EVERY = "5 seconds"
LOG_SYNC_EVERY = "3 seconds"


# --- job queue ----------------------------------------------------------------------------

def job_queue_stream(spark: SparkSession, queue_dir: str, schema, max_files: int = 1) -> DataFrame:
    """Queued JSON job objects; each file is taken once (tracked by the checkpoint)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(queue_dir)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The id that a queued item's name ends in.
UUID_END = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def taken_once(stream: DataFrame, key: str, id_pattern: str | None = None) -> DataFrame:
    """The first row of each ``key``, however long ago it came: a streaming dedupe whose
    state, one key a job, lies in the state store, so a batch looks up its own keys
    only. With ``id_pattern`` only items whose key it finds are taken, as in a queue
    folder that also holds other objects; a null key is never one of them."""
    wanted = stream.where(F.col(key).rlike(id_pattern)) if id_pattern else stream
    return wanted.dropDuplicates([key])


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams started from here on in RocksDB, on disk with changelog
    checkpoints, so that it may outgrow the executors' memory. A provider that the
    session already names stays."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def route_jobs(out_dir: str, route: str) -> BatchFn:
    """Write every micro-batch into ``out_dir/batch=<id>/<route>=<type>/``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(route).parquet(f"{out_dir}/batch={batch_id}")
    return run


def read_routed(spark: SparkSession, out_dir: str, schema) -> DataFrame:
    """All routed jobs, with the batch each came in; none if nothing was queued. The
    declared schema keeps a job type like '007' text."""
    declared = spark.createDataFrame([], schema).schema.add("batch", "long")
    return spark.read.schema(declared).parquet(out_dir) if dir_exists(spark, out_dir) else spark.createDataFrame([], declared)


def consume_job_queue(spark: SparkSession, queue_dir: str, schema, route: str, max_files: int = 1,
                      dedupe_key: str | None = None, id_pattern: str | None = None, out_dir: str | None = None,
                      checkpoint: str | None = None) -> DataFrame:
    """Drain the queue (available-now) and return every routed job. With the folders of
    an earlier run it goes on where that one stopped."""
    out, ckpt = out_dir or scratch_dir(spark, "queue_out"), checkpoint or scratch_dir(spark, "queue_ckpt")
    jobs = job_queue_stream(spark, queue_dir, schema, max_files)
    if dedupe_key is not None:
        use_rocksdb(spark)
        jobs = taken_once(jobs, dedupe_key, id_pattern)
    run_available_now(jobs, route_jobs(out, route), ckpt)
    return read_routed(spark, out, schema).drop("batch")


# --- latest row per key -------------------------------------------------------------------

def change_log(out_dir: str) -> BatchFn:
    """Each micro-batch writes its changed rows into ``out_dir/batch=<id>``.

    Writing costs O(batch), never O(table); a replayed batch overwrites its own
    folder, so the log stays exactly-once. Readers fold the log with
    :func:`read_latest`; :class:`cirrus.streaming.merge_log.MergeLog` is the log for
    many batches."""
    def run(updates: DataFrame, batch_id: int) -> None:
        updates.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
    return run


def read_latest(spark: SparkSession, out_dir: str, key: Sequence[str]) -> DataFrame:
    """Current table of a change log: for every key the row of the latest batch
    (``max_by`` is a partial aggregate, so a hot key costs one row per map task)."""
    log = spark.read.parquet(out_dir)
    cols = [c for c in log.columns if c not in set(key) | {"batch"}]
    latest = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col("batch"))
    return log.groupBy(*key).agg(latest.alias("_row")).select(*key, "_row.*")


def latest_rows_stream(stream: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Streaming aggregate: newest row per key by ``order`` (``max_by`` state,
    one small struct per key in the state store)."""
    newest = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order]))
    return stream.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")


def keep_latest(spark: SparkSession, stream: DataFrame, key: str, order: Sequence[str],
                cols: Sequence[str]) -> DataFrame:
    """Keep the newest state per key while rows arrive; returns the merged table. The
    changed rows of the batches are folded in a compacted log."""
    newest = latest_rows_stream(stream, key, order, cols)

    def fold(rows: DataFrame) -> DataFrame:
        row = F.max_by(F.struct(*[F.col(c) for c in cols]), "_batch").alias("_row")
        return rows.groupBy(key).agg(row, F.max("_batch").alias("_batch")).select(key, "_row.*", "_batch")

    log = MergeLog(spark, scratch_dir(spark, "latest_state"), T.StructType([*newest.schema.fields, T.StructField("_batch", T.LongType())]), fold)
    run_available_now(newest, lambda rows, i: log.append(rows.withColumn("_batch", F.lit(i).cast("long")), i),
                      scratch_dir(spark, "latest_ckpt"), output_mode="update")
    return log.read().drop("_batch")


def mark_missing(recorded: DataFrame, key: str, latest: DataFrame, state: Column,
                 missing_label: str = "Terminated") -> DataFrame:
    """Refresh recorded rows from the latest live state: every recorded id gets
    its newest row and ``state``; an id the live side no longer has is marked
    ``missing_label`` (the row refresh's "lookup failed -> Terminated")."""
    live = latest.withColumn("state", state)
    return recorded.select(key).join(live, key, "left").withColumn(
        "state", F.coalesce(F.col("state"), F.lit(missing_label)))


# --- log sync -----------------------------------------------------------------------------

def sync_logs(spark: SparkSession, log_dir: str, max_files: int = 1) -> DataFrame:
    """Copy new log files line by line into a synced folder as they appear.

    The file source's checkpoint remembers which files were copied; each
    micro-batch appends its lines (with the source file and its size) into its
    own ``batch=<id>`` folder, so a replayed batch is overwritten, not doubled."""
    out = scratch_dir(spark, "logsync_out")
    ckpt = scratch_dir(spark, "logsync_ckpt")
    lines = (spark.readStream.option("maxFilesPerTrigger", max_files).option("lineSep", "\n").text(log_dir)
             .select("value", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_size").alias("file_size")))

    def copy(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_available_now(lines, copy, ckpt)
    return spark.read.parquet(out)


#: Files that one read of a sync round takes; their paths pass through the driver.
SYNC_FILES = 10_000


def sync_changed(spark: SparkSession, src_dir: str, dest_dir: str, manifest_dir: str, run_id: int) -> DataFrame:
    """One sync round for files that change in place (growing logs): list the
    source (metadata only), keep files whose (name, size) no earlier round recorded,
    copy their lines into ``dest_dir/run=<id>`` and record their (name, size) in
    ``manifest_dir/run=<id>``. Rerunning a round overwrites its own folders. Returns
    the files copied in this round; :func:`read_synced` reads their current copies.

    Only the changed files are read, SYNC_FILES at a time."""
    from itertools import islice

    from cirrus.operators.joins import anti_join
    from cirrus.sources.files import list_objects
    names = T.StructType([T.StructField("name", T.StringType()), T.StructField("bytes", T.LongType())])
    changed = list_objects(spark, src_dir).select("name", "bytes")
    if dir_exists(spark, manifest_dir):
        seen = spark.read.schema(names.add("run", "long")).parquet(manifest_dir).where(F.col("run") != run_id)
        changed = anti_join(changed, seen.select("name", "bytes"), ["name", "bytes"])
    # the round's work list, fixed before copying (outside the manifest, which
    # only gains the round once its copy is written)
    pending = f"{manifest_dir.rstrip('/')}_pending/run={run_id}"
    changed.write.mode("overwrite").parquet(pending)
    changed = spark.read.parquet(pending)
    base = src_dir.rstrip("/") + "/"
    remove_dir(spark, f"{dest_dir}/run={run_id}")
    todo = (base + r["name"] for r in changed.select("name").toLocalIterator())
    while paths := list(islice(todo, SYNC_FILES)):
        lines = spark.read.option("lineSep", "\n").text(paths).select(
            F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + base.split(":", 1)[-1].replace(".", "\\."), "")
             .alias("name"), "value")
        lines.write.mode("append").parquet(f"{dest_dir}/run={run_id}")
    changed.write.mode("overwrite").parquet(f"{manifest_dir}/run={run_id}")
    return spark.read.parquet(f"{manifest_dir}/run={run_id}")


def read_synced(spark: SparkSession, dest_dir: str, manifest_dir: str) -> DataFrame:
    """(name, value): the lines of each file as of the last round that copied it."""
    last = spark.read.parquet(manifest_dir).groupBy("name").agg(F.max("run").alias("run"))
    return spark.read.parquet(dest_dir).join(last, ["name", "run"], "left_semi").select("name", "value")


# --- logs that grow at their end --------------------------------------------------------------

_TAKEN = "path string, taken long, began long"


def sync_appended(spark: SparkSession, src_dir: str, dest_dir: str, manifest_dir: str, run_id: int,
                  glob: str | None = None) -> DataFrame:
    """One round that copies only what files have gained: the manifest holds, per file, the
    bytes taken so far; executors seek there and read the complete lines that follow
    into ``dest_dir/run=<id>``. A line without its line feed waits for a later round. A
    file shorter than what was taken of it has begun anew and is read from its start.
    Returns (path, taken, began) of the files read.

    The work list is written before lines are copied, and the manifest gains the round
    after them, so rerunning a round that died replaces what it left. No path and no line
    passes through the driver."""
    from cirrus.sources.log_files import list_files, read_lines
    files, taken, fresh = list_files(spark, src_dir, glob), F.col("taken"), F.lit(run_id).cast("long")
    if dir_exists(spark, manifest_dir):
        known = _last_taken(spark, manifest_dir, F.col("run") != run_id)
    else:
        known = spark.createDataFrame([], _TAKEN)
    anew = taken.isNull() | (F.col("bytes") < taken)
    pending = f"{manifest_dir.rstrip('/')}_pending/run={run_id}"
    (files.join(known, "path", "left")
     .select("path", F.when(anew, 0).otherwise(taken).cast("long").alias("first"), F.col("bytes").alias("last"),
             F.when(anew, fresh).otherwise(F.col("began")).alias("began"))
     .where(F.col("last") > F.col("first")).write.mode("overwrite").parquet(pending))
    work, out = spark.read.parquet(pending), f"{dest_dir}/run={run_id}"
    read_lines(work).write.mode("overwrite").parquet(out)
    ends = spark.read.parquet(out).groupBy("path").agg(F.max("end").alias("end"))
    (work.join(ends, "path", "left").select("path", F.coalesce("end", "first").alias("taken"), "began")
     .write.mode("overwrite").parquet(f"{manifest_dir}/run={run_id}"))
    return spark.read.parquet(f"{manifest_dir}/run={run_id}")


def _last_taken(spark: SparkSession, manifest_dir: str, wanted: Column) -> DataFrame:
    rounds = spark.read.schema(_TAKEN + ", run long").parquet(manifest_dir).where(wanted)
    return rounds.groupBy("path").agg(F.max_by(F.struct("taken", "began"), "run").alias("_last")).select("path", "_last.*")


def read_appended(spark: SparkSession, dest_dir: str, manifest_dir: str) -> DataFrame:
    """(path, start, value): the lines of each file, since it last began, of finished rounds."""
    rounds = spark.read.schema(_TAKEN + ", run long").parquet(manifest_dir).select("path", "run")
    began = _last_taken(spark, manifest_dir, F.lit(True)).select("path", "began")
    lines = spark.read.schema("path string, start long, end long, value string, run long").parquet(dest_dir)
    return (lines.join(rounds, ["path", "run"], "left_semi").join(began, "path").where("run >= began")
            .select("path", "start", "value"))


# --- period statistics ----------------------------------------------------------------------

def period_window(ts: str, period_s: int, origin: dt.datetime | None = None) -> Column:
    """Tumbling event-time window of ``period_s`` seconds whose buckets start at
    ``origin`` (the batch rule), not at the epoch: the window's start offset is
    the origin's distance from the epoch modulo the period."""
    offset = 0 if origin is None else int((origin - dt.datetime(1970, 1, 1)).total_seconds()) % period_s
    return F.window(ts, f"{period_s} seconds", startTime=f"{offset} seconds")


def period_stats(df: DataFrame, ts: str, keys: Sequence[str], volume: str, period_s: int,
                 origin: dt.datetime | None = None) -> DataFrame:
    """Statistics of each window that merge: count, min, max, sum, first and last time."""
    return (df.groupBy(period_window(ts, period_s, origin).alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("count"), F.min(volume).alias("min"), F.max(volume).alias("max"),
                 F.sum(volume).alias("sum_raw"), F.min(ts).alias("duration_start"), F.max(ts).alias("duration_end"))
            .select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), *keys,
                    "count", "min", "max", "sum_raw", "duration_start", "duration_end"))


def merge_period_stats(partial: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per window and key from the batches' partial statistics."""
    return partial.groupBy("period_start", "period_end", *keys).agg(
        F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.sum("sum_raw").alias("sum_raw"), F.min("duration_start").alias("duration_start"),
        F.max("duration_end").alias("duration_end"))


def stats_current(spark: SparkSession, stream: DataFrame, ts: str, keys: Sequence[str], volume: str,
                  period_s: int = 86400, origin: dt.datetime | None = None) -> DataFrame:
    """Keep the statistics current while samples arrive, available-now: each
    micro-batch adds its own partial statistics to a compacted log, and they are merged on
    read. No sample is too late, in whatever order the files come, and there is no state to grow."""
    schema = period_stats(spark.createDataFrame([], stream.schema), ts, keys, volume, period_s, origin).schema
    log = MergeLog(spark, scratch_dir(spark, "stats_log"), schema,
                   lambda rows: merge_period_stats(rows, keys).select(schema.names))
    run_available_now(stream, lambda batch, i: log.append(period_stats(batch, ts, keys, volume, period_s, origin), i),
                      scratch_dir(spark, "stats_ckpt"))
    return log.read()


def rounded_stats(df: DataFrame) -> list[Column]:
    s = F.round(F.col("sum_raw"), 2)
    return [F.col("count"), F.col("min"), F.col("max"), s.alias("sum"), (s / F.col("count")).alias("avg")]
