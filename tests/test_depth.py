"""Ordered reducers, the rollup pyramid, compacted logs, stateful streams, and checks of
values that the shared tables do not hold."""

import datetime as dt
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cirrus.operators import enrich as EN
from cirrus.operators import graph as G
from cirrus.operators import metering as M
from cirrus.operators import programs as P
from cirrus.operators import rollup as R
from cirrus.operators import sorting as SO
from cirrus.session import make_dir, scratch_dir
from cirrus.sources.tables import Tables
from cirrus.streaming import jobs as SJ
from cirrus.streaming import live
from cirrus.streaming.merge_log import MergeLog


# --- ordered reducers --------------------------------------------------------------------

def brute_gaps(rows, idle_us):
    per = defaultdict(list)
    for k, t in rows:
        per[k].append(t)
    out = {}
    for k, ts in per.items():
        ts.sort()
        sessions, longest = [[ts[0], ts[0]]], 0
        for a, b in zip(ts, ts[1:]):
            longest = max(longest, b - a)
            if b - a > idle_us:
                sessions.append([b, b])
            sessions[-1][1] = b
        out[k] = (len(ts), ts[0], ts[-1], longest, len(sessions), max(b - a for a, b in sessions))
    return out


@pytest.mark.parametrize("batch,partitions", [("7", 5), ("1000", 1), ("50", 16)])
def test_ordered_program_splits_a_hot_key(spark, batch, partitions):
    rng = random.Random(int(batch))
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None, *range(10, 60)]), rng.randrange(0, 4_000_000)) for _ in range(1500)]
    frame = spark.createDataFrame(rows, "k long, us long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = P.reduce_ordered(frame, ["k"], ["us"], P.Gaps("us", 1), partitions).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_gaps(rows, 1_000_000)
    micros = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    assert len(got) == len(want)
    assert {r["k"]: (r["samples"], micros(r["first_sample"]), micros(r["last_sample"]), r["longest_gap_us"], r["sessions"],
                     r["longest_session_us"]) for r in got} == want


def test_ordered_program_of_nothing(spark):
    got = P.reduce_ordered(spark.createDataFrame([], "k long, us long"), ["k"], ["us"], P.Gaps("us", 1))
    assert got.collect() == [] and "sessions" in got.columns


# --- rollup pyramid ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def pyramid(spark, sf_small):
    e = Tables(spark, sf_small).events
    samples = e.select("ts", F.col("event_type").alias("meter"), F.col("value").alias("volume"))
    return samples, R.build(samples, ["meter"], scratch_dir(spark, "pyramid_test"))


@pytest.mark.parametrize("period,origin", [(86400, "2024-01-01 00:00:00"), (3600, "2024-01-01 00:30:00"), (50_000, "2024-01-02 03:17:25"),
                                           (97, "2024-01-05 00:00:01.5"), (60, "2024-01-01 00:00:00"), (10_000_000, "2023-12-31 23:59:59"),
                                           (86400 * 7, "2024-01-03 12:00:00")])
def test_rollup_equals_direct(pyramid, period, origin):
    samples, pyr = pyramid
    origin = dt.datetime.fromisoformat(origin)
    got = R.stats_by_period(pyr, period, origin)
    want = M.stats_by_period(samples.where(F.col("ts") >= F.lit(origin).cast("timestamp_ntz")), ["meter"], period, origin)
    text = lambda df: sorted(str(tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r)) for r in df.select(want.columns).collect())
    assert text(got) == text(want)


def test_rollup_until_and_aligned_queries_read_no_raw_samples(pyramid):
    samples, pyr = pyramid
    low, high = dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 6, 5)
    got = R.stats_by_period(pyr, 7200, low, until=high)
    bound = (F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.lit(high).cast("timestamp_ntz"))
    assert got.agg(F.sum("count")).first()[0] == samples.where(bound).count()
    assert not any("/raw/" in f for f in got.inputFiles())
    odd = R.stats_by_period(pyr, 50_000, dt.datetime(2024, 1, 2, 3, 17, 25))
    assert any("/raw/" in f for f in odd.inputFiles())
    assert "In(cell" in odd._jdf.queryExecution().toString()      # the border cells are pushed down


def test_rollup_levels_must_nest(spark, pyramid):
    with pytest.raises(ValueError):
        R.build(pyramid[0], ["meter"], scratch_dir(spark, "pyramid_bad"), levels=(60, 100))


# --- compacted log -----------------------------------------------------------------------

def _sums(rows):
    return rows.groupBy("k").agg(F.sum("n").cast("long").alias("n"))


def test_merge_log_stays_small_and_whole(spark):
    log = MergeLog(spark, scratch_dir(spark, "merge_log"), "k long, n long", _sums, fanout=3)
    assert log.read().count() == 0
    want = defaultdict(int)
    for i in range(50):
        rows = [(i % 7, i), (100, 1)]
        for k, n in rows:
            want[k] += n
        log.append(spark.createDataFrame(rows, "k long, n long").coalesce(1), i)
        assert len(log.manifest()["runs"]) <= 2 * 4        # fanout - 1 a tier
    assert {r["k"]: r["n"] for r in log.read().collect()} == want
    assert len(log._versions()) == 2                        # older manifests are gone
    log.append(spark.createDataFrame([(1, 1000)], "k long, n long"), 49)      # a batch replayed after its commit
    assert {r["k"]: r["n"] for r in log.read().collect()} == want


def test_merge_log_crash_between_write_and_commit(spark, monkeypatch):
    log = MergeLog(spark, scratch_dir(spark, "merge_crash"), "k long, n long", _sums, fanout=2)
    one = lambda n: spark.createDataFrame([(1, n)], "k long, n long")
    log.append(one(1), 0)

    def crash(state):
        raise RuntimeError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(log, "_commit", crash)
        with pytest.raises(RuntimeError):
            log.append(one(10), 1)
    assert log.read().first()["n"] == 1
    log.append(one(10), 1)                                  # the batch is replayed
    log.append(one(100), 2)
    assert log.read().first()["n"] == 111
    old = log.manifest()
    log._commit({**old, "version": old["version"] + 1})
    with pytest.raises(Exception):                          # a second writer loses
        log._commit({**old, "version": old["version"] + 1})


# --- job queue ---------------------------------------------------------------------------

def _queue(spark, folder, name, items):
    local = folder[len("file:"):] if folder.startswith("file:") else folder
    with open(f"{local}/{name}.json", "w") as out:
        out.write("\n".join(json.dumps({"key": k, "kind": t, "n": n}) for k, t, n in items))


def test_job_queue_keeps_ids_in_the_state_store(spark):
    folder = make_dir(spark, scratch_dir(spark, "queue_state"))
    out, ckpt = scratch_dir(spark, "queue_state_out"), scratch_dir(spark, "queue_state_ckpt")
    uid = lambda i: f"job/g/queue/{i:08x}-0000-4000-8000-{i:012x}"
    drain = lambda: SJ.consume_job_queue(spark, folder, "key STRING, kind STRING, n LONG", "kind", dedupe_key="key",
                                         id_pattern=SJ.UUID_END, out_dir=out, checkpoint=ckpt)
    for i in range(12):
        _queue(spark, folder, f"a{i}", [(uid(i), "007", i), (uid(0), "x", -1), ("job/g/meta.json", "y", 0)])
    first = {r["key"]: r for r in drain().collect()}
    assert set(first) == {uid(i) for i in range(12)} and first[uid(5)]["kind"] == "007"
    kept = first[uid(0)]["n"]
    _queue(spark, folder, "b", [(uid(0), "x", -7), (uid(20), "x", 20), (None, "x", 1)])    # after a restart
    second = drain().collect()
    assert len(second) == 13 and {r["key"]: r["n"] for r in second}[uid(0)] == kept
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == SJ.ROCKSDB


# --- rows that vanish --------------------------------------------------------------------

def test_rows_vanish_and_return(spark):
    folder = make_dir(spark, scratch_dir(spark, "live_src"))
    log, ckpt = scratch_dir(spark, "live_log"), scratch_dir(spark, "live_ckpt")
    day = dt.datetime(2024, 5, 1)
    at = lambda h: day + dt.timedelta(hours=h)
    schema = "id long, ts timestamp_ntz, seq long, state string, load double"

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        table = live.keep_live(spark, stream, "id", "ts", "seq", ["ts", "state", "load"], 3600, checkpoint=ckpt, log_dir=log)
        return {r["id"]: (r["ts"], r["state"], r["load"], r["live"]) for r in table.collect()}

    got = step([(1, at(0), 1, "up", 0.1), (1, at(0), 2, "busy", 0.123456789012), (2, at(0.5), 3, "up", None)])
    assert got == {1: (at(0), "busy", 0.123456789012, True), 2: (at(0.5), "up", None, True)}
    got = step([(2, at(1.25), 4, "up", 2.0), (None, at(9), 5, "up", 1.0), (3, None, 6, "up", 1.0)])
    assert got == {1: (at(0), "busy", 0.123456789012, False), 2: (at(1.25), "up", 2.0, True)}      # 1 is silent
    got = step([(1, at(1.5), 7, "back", 3.0), (2, at(1.3), 8, "down", 4.0)])
    assert got[1] == (at(1.5), "back", 3.0, True) and got[2] == (at(1.3), "down", 4.0, True)       # 1 returns
    got = step([(4, at(9), 9, None, 1.0)])
    assert got == {1: (at(1.5), "back", 3.0, False), 2: (at(1.3), "down", 4.0, False), 4: (at(9), None, 1.0, True)}


# --- values beyond the shared tables -------------------------------------------------------

def test_meter_unit_of_a_name_that_ends_in_rate(spark):
    rows = [(5, "click", 1.0), (3, "click", 200.0), (9, "click.rate", 7.0), (10, "click.rate", 900.0), (1, "view", None)]
    got = EN.meter_units(spark.createDataFrame(rows, "event_id long, event_type string, value double")).collect()
    assert sorted(tuple(r) for r in got) == [("click", "B"), ("click.rate", "count"), ("click.rate.rate", ""), ("view", "B"), ("view.rate", "")]


def test_main_edge_of_any_id(spark):
    top, low = (1 << 63) - 1, -(1 << 63)
    rows = [(1, 2, 5), (1, 1, (1 << 48) + 7), (1, 1, (1 << 48) + 8), (2, 1, -3), (3, 4, top), (4, 0, low), (4, 0, low + 1), (5, -2, 9), (5, 3, 1),
            (6, 2147483647, top)]
    got = SO.first_by_position(spark.createDataFrame(rows, "o long, p int, v long"), "o", "p", "v", "net").collect()
    assert {r["o"]: r["net"] for r in got} == {1: (1 << 48) + 7, 2: -3, 3: top, 4: low, 5: 9, 6: top}


def test_long_lists_fail_before_they_are_built(spark):
    rows = spark.range(40).select((F.col("id") % 3).alias("k"), F.col("id"), (F.col("id") % 2).alias("two"))
    assert EN.bounded(rows, "k", most=14).count() == 40 and EN.bounded(rows, "k", distinct="two", most=2).count() == 40
    with pytest.raises(Exception, match="a list above 13 items: 14"):
        EN.bounded(rows, "k", most=13).count()
    plan = EN.ordered_array(rows, "k", "id", "two", "x")._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan       # counted before
    assert EN.bounded(rows.limit(0), "k").count() == 0


def test_folder_totals_of_odd_keys(spark):
    keys = ["a/b/c", "a/b/d", "a/x", "top", "", None, "a//y", "/z", "a/b/"]
    got = G.folder_totals(spark.createDataFrame([(k, 2) for k in keys], "key string, n long"), "key", "n").collect()
    want = defaultdict(lambda: [0, 0])
    for k in keys:
        parts = (k or "").split("/")
        for d in range(1, len(parts)):
            at = want["/".join(parts[:d]) + "/", d]
            at[0] += 1
            at[1] += d == len(parts) - 1
    assert {(r["folder"], r["depth"]): [r["n_keys"], r["n_direct"]] for r in got} == want
    assert all(r["n_bytes"] == 2 * r["n_keys"] for r in got)


def test_variant_fields_of_odd_texts(spark):
    from cirrus.functions.display import variant_fields
    texts = ['{"k": 5}', '{"k": null}', '{}', None, 'not json', '[1]', '{"k": true}', '{"k": {"name": null}, "tags": []}', '{"k": "t", "tags": [7]}']
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", F.try_parse_json("t").alias("m"))
    got = {r["id"]: tuple(r)[1:] for r in variant_fields(frame, "m").collect()}
    assert [got[i][0] for i in range(9)] == ["number", "null", "missing", "missing", "missing", "missing", "other", "object", "text"]
    assert got[0][1] == 5 and got[8][2] == "t" and got[8][4] == "7" and got[7][2] is None


# --- paging and listings -----------------------------------------------------------------

def test_pages_both_ways_make_up_the_full_sort(spark):
    from cirrus.operators.table import page_around_marker
    rows = [(i // 7 % 5, i) for i in range(83)]
    frame = spark.createDataFrame(rows, "a long, b long").repartition(4)
    for backward in (False, True):
        marker, pages = None, []
        while True:
            page = [(r["a"], r["b"], r["has_more"]) for r in page_around_marker(frame, ["a", "b"], marker, 20, backward).collect()]
            pages.append([p[:2] for p in page])
            if not page[0][2]:
                break
            marker = pages[-1][0 if backward else -1]
        assert [x for p in (reversed(pages) if backward else pages) for x in p] == sorted(rows) and len(pages) == 5
    assert page_around_marker(frame, ["a", "b"], (0, 0), 20, True).collect() == []


def test_listing_at_any_prefix_and_delimiter(spark):
    keys = ["a/b/c", "a/b/d", "a/x", "ab", "abc", "a", "", None, "b/a", "a//y", "a%b", "a/b::c"]
    frame = spark.createDataFrame([(k, 1) for k in keys], "key string, n long")
    got = lambda p, d: {(r["entry"], r["kind"], r["n_keys"]) for r in G.list_prefix(frame, "key", "n", p, d).collect()}
    assert got("a", "/") == {("a/", "folder", 5), ("ab", "object", 1), ("abc", "object", 1), ("a", "object", 1), ("a%b", "object", 1)}
    assert got("a/", "/") == {("a/b/", "folder", 2), ("a/x", "object", 1), ("a//", "folder", 1), ("a/b::c", "object", 1)}
    assert got("a/b", "::") == {("a/b/c", "object", 1), ("a/b/d", "object", 1), ("a/b::", "folder", 1)}
    assert sum(n for _, _, n in got("", "/")) == len(keys) - 1 and all(k == "object" for _, k, _ in got("", ""))
