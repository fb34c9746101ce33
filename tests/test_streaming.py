"""Streams must converge to their batch twins, also over several micro-batches."""

from pyspark.sql import functions as F

from cirrus.session import make_dir, scratch_dir
from cirrus.sources.tables import SCHEMAS, Tables
from cirrus.streaming import jobs as SJ


def _split_events(spark, sf_dir, n=4):
    path = scratch_dir(spark, "events_split")
    Tables(spark, sf_dir).events.repartition(n).write.mode("overwrite").parquet(path)
    return path


def test_latest_rows_over_many_batches(spark, sf_small):
    path = _split_events(spark, sf_small)
    stream = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(path)
    got = SJ.keep_latest(spark, stream, "user_id", ["ts", "event_id"], ["ts", "event_type", "value"])
    e = Tables(spark, sf_small).events
    want = e.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_type", "value"),
                                             F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")
    assert got.select(*want.columns).exceptAll(want).count() == 0
    assert want.exceptAll(got.select(*want.columns)).count() == 0
    # the input really is several files, read one per micro-batch
    assert len(spark.read.parquet(path).inputFiles()) >= 2


def test_period_stats_over_many_batches(spark, sf_small):
    path = _split_events(spark, sf_small)
    stream = (spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(path)
              .withColumn("ts", F.col("ts").cast("timestamp")))
    cur = SJ.stats_current(spark, stream, "ts", ["user_id", "event_type"], "value", 86400)
    got = cur.select("user_id", "event_type", F.col("period_start").cast("timestamp_ntz").alias("d"), "count")
    e = Tables(spark, sf_small).events
    want = e.groupBy("user_id", "event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d")) \
        .agg(F.count(F.lit(1)).alias("count"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_job_queue_takes_each_item_once(spark, sf_small):
    queue = scratch_dir(spark, "queue_test")
    c = Tables(spark, sf_small).conversations
    c.repartition(3).write.mode("overwrite").json(queue)
    out = SJ.consume_job_queue(spark, queue, SCHEMAS["conversations"].simpleString()[7:-1].replace(":", " "),
                               route="role")
    assert out.count() == c.count()
    assert out.select("conv_id", "turn").distinct().count() == c.select("conv_id", "turn").distinct().count()


def test_polling_trigger_processes_new_files(spark, sf_small):
    """A continuously polling stream picks up files that arrive after it started."""
    import time
    src = scratch_dir(spark, "poll_src")
    out = scratch_dir(spark, "poll_out")
    ckpt = scratch_dir(spark, "poll_ckpt")
    e = Tables(spark, sf_small).events
    e.limit(10).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMAS["events"]).parquet(src)
    q = SJ.start_polling(stream, SJ.change_log(out), ckpt, every="500 milliseconds")
    try:
        q.processAllAvailable()
        e.write.mode("append").parquet(src)
        time.sleep(1.0)
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(out).count() == 10 + e.count()


def test_period_stats_window_origin_matches_batch(spark, sf_small):
    """Buckets of an odd period start at the query origin in both forms."""
    import datetime as dt
    from cirrus.operators import metering as M
    origin, period = dt.datetime(2024, 1, 1, 3, 17), 6479
    e = Tables(spark, sf_small).events.where(F.col("ts") >= F.lit(origin).cast("timestamp_ntz"))
    path = scratch_dir(spark, "events_origin")
    e.repartition(3).write.mode("overwrite").parquet(path)
    stream = (spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(path)
              .withColumn("ts", F.col("ts").cast("timestamp")))
    cur = SJ.stats_current(spark, stream, "ts", ["user_id"], "value", period, origin=origin)
    got = cur.select("user_id", F.col("period_start").cast("timestamp_ntz").alias("p"), "count")
    want = M.stats_by_period(e.select("ts", "user_id", F.col("value").alias("volume")), ["user_id"], period, origin) \
        .select("user_id", F.col("period_start").alias("p"), "count")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_sync_changed_copies_new_and_grown_files(spark):
    import os
    src = make_dir(spark, scratch_dir(spark, "sync_src"))
    dest, manifest = scratch_dir(spark, "sync_dest"), scratch_dir(spark, "sync_manifest")
    local = src[len("file:"):] if src.startswith("file:") else src
    with open(os.path.join(local, "a.log"), "w") as f:
        f.write("one\ntwo\n")
    with open(os.path.join(local, "b.log"), "w") as f:
        f.write("x\n")
    first = sorted(r["name"] for r in SJ.sync_changed(spark, src, dest, manifest, 0).collect())
    assert first == ["a.log", "b.log"]
    with open(os.path.join(local, "a.log"), "a") as f:          # the log grows
        f.write("three\n")
    second = sorted(r["name"] for r in SJ.sync_changed(spark, src, dest, manifest, 1).collect())
    assert second == ["a.log"]
    third = SJ.sync_changed(spark, src, dest, manifest, 2).count()
    assert third == 0
    copied = spark.read.parquet(f"{dest}/run=1").where(F.col("name") == "a.log").count()
    assert copied == 3
    now = sorted((r["name"], r["value"]) for r in SJ.read_synced(spark, dest, manifest).collect())
    assert now == [("a.log", "one"), ("a.log", "three"), ("a.log", "two"), ("b.log", "x")]


def test_replayed_batch_is_not_duplicated(spark, sf_small):
    """A batch that wrote its output and then died is replayed on restart from the
    checkpoint; its folder is overwritten, so every row lands exactly once."""
    import pytest
    path = _split_events(spark, sf_small)
    out, ckpt = scratch_dir(spark, "replay_out"), scratch_dir(spark, "replay_ckpt")
    sink = SJ.change_log(out)
    failed = []

    def flaky(batch, batch_id):
        sink(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("simulated loss after the sink write, before the commit")

    def stream():
        return spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(path)

    with pytest.raises(Exception):
        SJ.run_available_now(stream(), flaky, ckpt)
    SJ.run_available_now(stream(), sink, ckpt)           # restart from the checkpoint
    got = spark.read.parquet(out)
    assert failed == [1]
    assert got.count() == Tables(spark, sf_small).events.count()
    assert got.select("event_id").distinct().count() == got.count()


def test_job_queue_dedupes_a_job_queued_twice(spark, sf_small):
    queue = scratch_dir(spark, "queue_dupes")
    c = Tables(spark, sf_small).conversations
    jobs = c.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("job_id"),
                    F.col("role").alias("job_type"))
    jobs.coalesce(1).write.mode("append").json(queue)
    jobs.where(F.col("job_type") == "user").coalesce(1).write.mode("append").json(queue)   # queued again
    schema = "job_id string, job_type string"
    once = SJ.consume_job_queue(spark, queue, schema, route="job_type", max_files=1, dedupe_key="job_id")
    assert once.count() == c.count()
    twice = SJ.consume_job_queue(spark, queue, schema, route="job_type", max_files=1)
    assert twice.count() == c.count() + c.where(F.col("role") == "user").count()


def test_stateful_replay_keeps_latest_rows_exact(spark, sf_small):
    """Update-mode state restored from the checkpoint re-emits the lost batch's
    changes; the change log folds to the same newest rows as the batch twin."""
    import pytest
    path = _split_events(spark, sf_small)
    out, ckpt = scratch_dir(spark, "replay_state_out"), scratch_dir(spark, "replay_state_ckpt")
    sink = SJ.change_log(out)
    failed = []

    def flaky(batch, batch_id):
        sink(batch, batch_id)
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            raise RuntimeError("simulated loss after the sink write, before the commit")

    def agg():
        s = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(path)
        return SJ.latest_rows_stream(s, "user_id", ["ts", "event_id"], ["ts", "event_type", "value"])

    with pytest.raises(Exception):
        SJ.run_available_now(agg(), flaky, ckpt, output_mode="update")
    SJ.run_available_now(agg(), sink, ckpt, output_mode="update")
    got = SJ.read_latest(spark, out, ["user_id"]).select("user_id", "ts", "event_type", "value")
    e = Tables(spark, sf_small).events
    want = e.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_type", "value"),
                                             F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")
    assert failed == [2]
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_period_stats_take_samples_of_any_age(spark, sf_small):
    """Registered settings, one file per batch, files in no order of time."""
    import datetime as dt
    path = scratch_dir(spark, "events_shuffled")
    Tables(spark, sf_small).events.repartition(7, "event_id").write.parquet(path)
    stream = (spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(path)
              .withColumn("ts", F.col("ts").cast("timestamp")))
    cur = SJ.stats_current(spark, stream, "ts", ["user_id", "event_type"], "value", 86400, origin=dt.datetime(2024, 1, 1))
    assert cur.agg(F.sum("count")).first()[0] == Tables(spark, sf_small).events.count()
    assert cur.count() == cur.select("period_start", "user_id", "event_type").distinct().count()


def test_old_dated_jobs_and_empty_queues(spark):
    import os
    queue = make_dir(spark, scratch_dir(spark, "queue_old"))
    local = queue[len("file:"):] if queue.startswith("file:") else queue
    schema = "job_id string, job_type string"
    assert SJ.consume_job_queue(spark, queue, schema, route="job_type", dedupe_key="job_id").count() == 0
    for name, ids, age in (("a.json", [1, 2, 3], 0), ("b.json", [4, 5, 1], 3 * 3600), ("c.json", [3, 6], 9 * 3600)):
        path = os.path.join(local, name)
        with open(path, "w") as f:
            f.writelines(f'{{"job_id": "{i}", "job_type": "007"}}\n' for i in ids)
        then = os.path.getmtime(path) - age
        os.utime(path, (then, then))
    rows = SJ.consume_job_queue(spark, queue, schema, route="job_type", max_files=1, dedupe_key="job_id").collect()
    assert sorted(r["job_id"] for r in rows) == list("123456") and {r["job_type"] for r in rows} == {"007"}
