"""Queries for SURVEY section 2.10: streaming. Each runs its Structured Streaming
job available-now over the table's data and returns the sink as a DataFrame, so
the oracle can compare it with the batch result the stream must converge to."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirrus.plans.q_aggregates import PERIOD_ORIGIN
from cirrus.plans.registry import query
from cirrus.session import scratch_dir
from cirrus.sources.tables import SCHEMAS, Tables, table_path
from cirrus.streaming import jobs as SJ

S = "2.10"

QUEUE_SCHEMA = "job_id STRING, job_type STRING, conv_id BIGINT, turn BIGINT, text STRING"
#: Files per micro-batch. Batches stay bounded on a large backlog; the tests
#: drive the same jobs one file per batch to exercise the merge across batches.
FILES_PER_BATCH = 1000
ALL_FILES = 2_000_000_000
JOBS_PER_FILE = 100_000


def _table_stream(spark, sf_dir: str, name: str, max_files: int = FILES_PER_BATCH):
    """A table as a file stream source: a folder of parquet files is streamed as
    is; a single-file table is picked out of its folder with a name filter (a
    file stream source needs a folder)."""
    path = table_path(sf_dir, name)
    reader = spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", max_files)
    files = spark.read.schema(SCHEMAS[name]).parquet(path).inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


@query("stream_job_queue", section=S, sql="""
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS job_id, role AS job_type, conv_id, turn, text
FROM conversations
""")
def stream_job_queue(spark, sf_dir):
    """Conversation turns queued as JSON job objects (several files), drained by
    a checkpointed file stream that takes each file once, drops a job id that
    was queued before (ids in the state store), and routes every job to a folder
    per job type."""
    queue = scratch_dir(spark, "queue")
    c = Tables(spark, sf_dir).conversations
    jobs = c.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("job_id"),
                    F.col("role").alias("job_type"), "conv_id", "turn", "text")
    jobs.write.mode("overwrite").option("maxRecordsPerFile", JOBS_PER_FILE).json(queue)
    routed = SJ.consume_job_queue(spark, queue, QUEUE_SCHEMA, route="job_type", max_files=FILES_PER_BATCH,
                                  dedupe_key="job_id")
    return routed.select("job_id", "job_type", "conv_id", "turn", "text")


@query("stream_latest_rows", section=S, sql="""
WITH l AS (SELECT user_id, arg_max(ts, (ts, event_id)) AS ts, arg_max(event_type, (ts, event_id)) AS event_type,
                  arg_max(value, (ts, event_id)) AS value
           FROM events GROUP BY user_id)
SELECT c.c_custkey AS user_id, l.ts, l.event_type, l.value,
       coalesce(upper(substring(l.event_type, 1, 1)) || substring(l.event_type, 2), 'Terminated') AS state
FROM customer c LEFT JOIN l ON l.user_id = c.c_custkey
""")
def stream_latest_rows(spark, sf_dir):
    """Keep the newest state per row id while samples stream in (update-mode
    aggregate; each batch's changed rows go to a change log folded on read),
    then refresh the recorded rows (customers): an id without live state is
    marked 'Terminated'."""
    from cirrus.functions.display import capfirst
    stream = _table_stream(spark, sf_dir, "events")
    latest = SJ.keep_latest(spark, stream, "user_id", ["ts", "event_id"], ["ts", "event_type", "value"])
    recorded = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("user_id"))
    return SJ.mark_missing(recorded, "user_id", latest, capfirst(F.col("event_type"))) \
        .select("user_id", "ts", "event_type", "value", "state")


SILENT_S = 86400


@query("stream_vanished_rows", section=S, sql=f"""
WITH l AS (SELECT user_id, arg_max(ts, (ts, event_id)) AS ts, arg_max(event_type, (ts, event_id)) AS event_type,
                  arg_max(value, (ts, event_id)) AS value
           FROM events GROUP BY user_id)
SELECT user_id, ts, event_type, value,
       CASE WHEN epoch_ms(ts) + {SILENT_S * 1000} < epoch_ms((SELECT max(ts) FROM events)) THEN 'Terminated'
            ELSE upper(substring(event_type, 1, 1)) || substring(event_type, 2) END AS state
FROM l
""")
def stream_vanished_rows(spark, sf_dir):
    """The newest row of each id, Terminated once the id has been silent for a day of
    event time: a timer per id emits the change while the stream runs. The files
    of a table come in no order of time, so all of them are one batch here."""
    from cirrus.functions.display import capfirst
    from cirrus.streaming import live
    stream = _table_stream(spark, sf_dir, "events", max_files=ALL_FILES)
    rows = live.keep_live(spark, stream, "user_id", "ts", "event_id", ["ts", "event_type", "value"], SILENT_S)
    return rows.select("user_id", "ts", "event_type", "value",
                       F.when(F.col("live"), capfirst(F.col("event_type"))).otherwise("Terminated").alias("state"))


@query("stream_log_sync", section=S, sql="""
SELECT unnest(string_split(text, chr(10))) AS value FROM documents
""")
def stream_log_sync(spark, sf_dir):
    """Log files (documents written as text, one folder per source) copied line by
    line as they appear; each file taken once."""
    logs = scratch_dir(spark, "logs")
    from cirrus.sources.files import write_partitioned
    write_partitioned(Tables(spark, sf_dir).documents.select("source", F.col("text").alias("value")),
                      logs, "source", fmt="text")
    return SJ.sync_logs(spark, logs + "/*", max_files=FILES_PER_BATCH).select("value")


@query("log_sync_appended", section=S, sql="""
SELECT unnest(string_split(text, chr(10))) AS value FROM documents
""")
def log_sync_appended(spark, sf_dir):
    """Log files (documents written as text, one folder per source) synced by byte ranges:
    executors seek to what is new, a hot source's files in blocks. A second round finds
    nothing more to read."""
    from cirrus.sources.files import write_partitioned
    logs, dest, manifest = (scratch_dir(spark, name) for name in ("grown_logs", "grown_dest", "grown_manifest"))
    write_partitioned(Tables(spark, sf_dir).documents.where("text is not null").select("source", F.col("text").alias("value")),
                      logs, "source", fmt="text")
    for round_no in range(2):
        SJ.sync_appended(spark, logs, dest, manifest, round_no)
    return SJ.read_appended(spark, dest, manifest).select("value")


@query("stream_period_stats", section=S, sql=f"""
WITH b AS (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '{PERIOD_ORIGIN}')) // 86400000000 AS bucket FROM events)
SELECT user_id AS resource, event_type AS meter,
       TIMESTAMP '{PERIOD_ORIGIN}' + to_seconds(bucket * 86400) AS period_start,
       count(*) AS count, min(value) AS min, max(value) AS max, round(sum(value), 2) AS sum,
       round(sum(value), 2) / count(*) AS avg
FROM b GROUP BY user_id, event_type, bucket
""")
def stream_period_stats(spark, sf_dir):
    """Daily statistics per (resource, meter) kept current while samples arrive:
    each micro-batch logs the partial statistics of its event-time windows, merged
    on read, so that no sample comes too late."""
    stream = _table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    import datetime as dt
    cur = SJ.stats_current(spark, stream, "ts", ["user_id", "event_type"], "value", 86400,
                           origin=dt.datetime(2024, 1, 1))
    return cur.select(F.col("user_id").alias("resource"), F.col("event_type").alias("meter"),
                      F.col("period_start").cast("timestamp_ntz").alias("period_start"), *SJ.rounded_stats(cur))
