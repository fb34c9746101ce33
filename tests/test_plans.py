"""Structural plan checks for every registered batch query."""

import contextlib
import io

import pytest

from cirrus.plans import registry

registry.load_all()
QUERIES = {k: v for k, v in registry.QUERIES.items() if not k.startswith("stream_")}
#: Queries that write and read back, check ids, or keep a fixed list: they run a job when built.
WRITES = {"src_text", "src_object_listing", "sink_csv_report", "sink_project_csv", "sink_instance_csv", "sink_series_json",
          "udtf_external_program", "lookup_unique", "gen_rows", "udtf_ordered_program", "stat_by_period_rollup",
          "filter_contains_indexed", "filter_wildcard_indexed", "lookup_clustered", "page_indexed", "page_indexed_previous"}
PANDAS_KEYS = {"stream_map_reduce", "udtf_external_program"}   # user programs, per Arrow batch


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_shape(spark, sf_small, key):
    plan = plan_of(QUERIES[key](spark, sf_small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan            # no row-at-a-time Python UDF anywhere
    if key not in PANDAS_KEYS:
        assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan


def test_scan_prunes_columns(spark, sf_small):
    plan = plan_of(QUERIES["filter_equal_attrs"](spark, sf_small))
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_orderpriority), EqualTo(o_orderstatus,O)" in plan
    assert "o_orderdate" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_tail_uses_partial_group_limit(spark, sf_small):
    tree = plan_of(QUERIES["tail_n"](spark, sf_small)).split("\n\n")[0]
    below_exchange = tree.split("Exchange")[1]
    assert "WindowGroupLimit" in below_exchange


def test_building_a_query_starts_no_job(spark, sf_small):
    sc = spark.sparkContext
    started = []
    for key in sorted(set(QUERIES) - WRITES):
        sc.setJobGroup(f"build-{key}", key)
        QUERIES[key](spark, sf_small)
        if sc.statusTracker().getJobIdsForGroup(f"build-{key}"):
            started.append(key)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert started == []
