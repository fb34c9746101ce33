"""Literal cases (the expectations the original tests pin) and operator properties."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cirrus.functions import display as D
from cirrus.functions import status as ST
from cirrus.functions import timefn as TF
from cirrus.operators import aggregates as AG
from cirrus.operators import jobs as J
from cirrus.operators import quota as QU
from cirrus.operators import table as TB
from cirrus.operators import udf as UD

INF = float("inf")


def plan_text(df, mode="formatted") -> str:
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def one(spark, col, schema="x string", rows=(("a",),)):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(col.alias("o")).collect()]


# --- quota -------------------------------------------------------------------------------

def test_quota_usage_literal_cases(spark):
    quotas = spark.createDataFrame(
        [("t", "instances", 10), ("t", "cores", 10), ("t", "ram", 10000), ("t", "floating_ips", 1),
         ("t", "volumes", -1), ("t", "gigabytes", None), ("t", "security_groups", 10)],
        "owner string, name string, limit bigint")
    tallies = spark.createDataFrame(
        [("t", "instances", 1), ("t", "cores", 1), ("t", "ram", 512), ("t", "floating_ips", 1),
         ("t", "floating_ips", 1), ("t", "volumes", 1), ("t", "gigabytes", None)],
        "owner string, name string, value bigint")
    got = {r["name"]: r for r in QU.quota_usage(quotas, tallies).collect()}
    assert (got["instances"]["used"], got["instances"]["available"]) == (1, 9.0)
    assert (got["floating_ips"]["used"], got["floating_ips"]["available"]) == (2, 0.0)   # 2 of 1 -> 0
    assert got["volumes"]["quota"] == INF and got["volumes"]["available"] == INF
    assert got["gigabytes"]["quota"] == INF and got["gigabytes"]["used"] == 0           # None counts 0
    assert got["security_groups"]["used"] is None and got["security_groups"]["available"] is None


def test_quota_label(spark):
    out = one(spark, D.quota_label(F.col("v"), "GB"), "v double", [(INF,), (5.0,), (None,)])
    assert out == ["No Limit", "5 GB Available", None]


# --- table layer ---------------------------------------------------------------------------

def test_summary_row_uses_raw_values(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, None)], "id int, value double")
    r = TB.summary_row(df, {"value": "average", "id": "sum"}).first()
    assert r["value_average"] == 3.0 and r["id_sum"] == 6


def test_summary_registry_unknown_name():
    with pytest.raises(ValueError):
        AG.summary_expr("median-ish", F.col("x"))


def test_truncate(spark):
    rows = [("a long string of text",), ("abc",)]
    assert one(spark, D.truncate_text(F.col("x"), 10), rows=rows) == ["a long ...", "abc"]
    assert one(spark, D.truncate_text(F.col("x"), 2), rows=rows) == ["a ", "ab"]


def test_fill_empty_only_null(spark):
    rows = [(None,), ("",), ("0",)]
    assert one(spark, D.fill_empty(F.col("x")), rows=rows) == ["-", "", "0"]


def test_status_of_value_null_is_none_text(spark):
    rows = [(None,), ("UP",), ("bogus",), ("Off",)]
    out = one(spark, ST.status_of_value(F.col("x"), [("none", True), ("up", True), ("off", False)]), rows=rows)
    assert out == [True, True, None, False]


def test_row_status_kleene(spark):
    df = spark.createDataFrame([(True, None), (False, None), (True, True)], "a boolean, b boolean")
    assert [r[0] for r in df.select(ST.row_status(F.col("a"), F.col("b"))).collect()] == [None, False, True]


def test_wildcard_first_term_only():
    assert TB.wildcard_like_pattern("Ab*Cd other*") == "%ab%cd%"
    assert TB.wildcard_like_pattern("***") == "%"
    assert TB.wildcard_like_pattern("50%_x") == "%50\\%\\_x%"


def test_wildcard_filter(spark):
    df = spark.createDataFrame([("abXcd",), ("cdab",), ("abcd",)], "name string")
    got = sorted(r[0] for r in TB.filter_wildcard(df, "name", "AB*CD zz").collect())
    assert got == ["abXcd", "abcd"]


def test_query_predicate_or_within_field(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (1, 9)], "id int, v int")
    conds = [{"field": "id", "op": "eq", "value": 1}, {"field": "id", "op": "eq", "value": 2},
             {"field": "v", "op": "le", "value": 5}]
    assert sorted(r["id"] for r in TB.filter_query(df, conds).collect()) == [1, 2]


def test_split_key_needs_three_parts(spark):
    rows = [("p__u__r",), ("p__u__r__x",)]
    out = one(spark, TB.split_key(F.col("x")), rows=rows)
    assert out[0] == ["p", "u", "r"] and out[1] is None


def test_lookup_unique_errors(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert TB.lookup_unique(df, "id", "1").count() == 1
    with pytest.raises(LookupError):
        TB.lookup_unique(df, "id", "9")
    with pytest.raises(ValueError):
        TB.lookup_unique(df, "id", "2")


def test_paging_concatenates_to_full_sort(spark):
    df = spark.range(0, 53).withColumnRenamed("id", "k")
    marker, seen = None, []
    while True:
        page = TB.page_after_marker(df, "k", marker if marker is not None else -1, 20).collect()
        seen += [r["k"] for r in sorted(page, key=lambda r: r["k"])]
        if not page[0]["has_more"]:
            break
        marker = page[0]["next_marker"]
    assert seen == list(range(53))


def test_filter_idempotent_and_semi_anti_partition(spark, sf_small):
    from cirrus.sources.tables import Tables
    t = Tables(spark, sf_small)
    c = t.customer.select("c_custkey")
    once = TB.filter_contains(t.part, "p_name", "ring")
    assert once.count() == TB.filter_contains(once, "p_name", "ring").count()
    o = t.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    semi, anti = c.join(o, "c_custkey", "left_semi"), c.join(o, "c_custkey", "left_anti")
    assert semi.count() + anti.count() == c.count()
    assert semi.intersect(anti).count() == 0


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("aki",), (None,), ("raw",)], "f string")
    assert [r[0] for r in TB.filter_not_in_nullsafe(df, "f", ["aki", "ari"]).collect()] == [None, "raw"]


# --- formatting -----------------------------------------------------------------------------

def test_size_format(spark):
    rows = [(None,), (512.0,), (1024.0,), (1536.0,), (3 * 1024.0 ** 3,)]
    assert one(spark, D.size_format(F.col("x")), "x double", rows) == ["0 bytes", "512", "1.0 KB", "1.5 KB", "3.0 GB"]
    assert one(spark, D.mb_format(F.col("x")), "x int", [(0,), (512,), (1024,), (None,)]) == ["0", "512MB", "1GB", "0"]
    assert one(spark, D.disk_gb_format(F.col("x")), "x int", [(20,)]) == ["20.0GB"]


def test_size_text_parse(spark):
    from cirrus.operators.sorting import size_text_bytes
    rows = [("12 MB",), ("1,024 KB",), ("1.5 kb",), ("512",), ("n/a",)]
    assert one(spark, size_text_bytes(F.col("x")), rows=rows) == [12 * 1024.0 ** 2, 1024.0, 1536.0, 512.0, None]


def test_label_case_and_capfirst(spark):
    assert one(spark, D.label_case(F.col("x")), rows=[("CREATE_IN_PROGRESS",)]) == ["Create In Progress"]
    assert one(spark, D.capfirst(F.col("x")), rows=[("active",)]) == ["Active"]


def test_rule_text(spark):
    df = spark.createDataFrame([("IPv4", "tcp", 22, 22, "ingress", None, "10.0.0.0/8"),
                                ("IPv4", "tcp", 80, 90, "egress", "web", None),
                                ("IPv6", "50", None, None, "ingress", None, None)],
                               "e string, p string, a int, b int, d string, g string, c string")
    out = [r[0] for r in df.select(D.rule_text(*[F.col(c) for c in "epabdgc"])).collect()]
    assert out == ["ALLOW IPv4 22/tcp from 10.0.0.0/8", "ALLOW IPv4 80-90/tcp to web", "ALLOW IPv6 ip_proto=50 from ANY"]


def test_classify(spark):
    rows = [("Cloud::Data::DBInstance",), ("Cloud::Compute::Server",), ("Cloud::Orchestration::Stack",)]
    assert one(spark, D.classify_type(F.col("x")), rows=rows) == ["DB", "SERVER", "UNKNOWN"]


# --- time -----------------------------------------------------------------------------------

def test_period_from_range(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, t + dt.timedelta(days=7)), (t, t + dt.timedelta(hours=5)), (t, None)],
                               "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(TF.period_from_range(F.col("a"), F.col("b"))).collect()] == [1512, 216, 86400]


def test_parse_multi_and_strict(spark):
    rows = [("2024-01-02T03:04:05.123456",), ("2024-01-02 03:04:05",), ("02/01/2024",)]
    out = one(spark, TF.parse_multi(F.col("x")), rows=rows)
    assert out[:2] == [dt.datetime(2024, 1, 2, 3, 4, 5, 123456), dt.datetime(2024, 1, 2, 3, 4, 5)] and out[2] is None
    with pytest.raises(Exception):
        one(spark, TF.parse_iso_strict(F.col("x")), rows=[("not a time",)])


def test_default_month_range(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 3),), (dt.datetime(2024, 3, 20),)], "d timestamp_ntz")
    s, e = TF.default_month_range(F.col("d"))
    got = [(r[0], r[1]) for r in df.select(s, e).collect()]
    assert got == [(dt.date(2024, 2, 1), dt.date(2024, 2, 29)), (dt.date(2024, 3, 1), dt.date(2024, 3, 20))]


# --- joins, jobs, udf --------------------------------------------------------------------------

def test_total_order_sort_spreads_hot_key(spark):
    hot = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"),
                                      "id")
    out = J.total_order_sort(hot, "k", 6).select("k", F.spark_partition_id().alias("p"))
    rows = out.collect()
    by_p = {}
    for r in rows:
        by_p.setdefault(r["p"], []).append(r["k"])
    parts = [by_p[p] for p in sorted(by_p)]
    assert all(max(a) <= min(b) for a, b in zip(parts, parts[1:]))
    assert sum(1 for p in parts if 7 in p) > 1          # the hot key is split over partitions
    assert len(rows) == 3000


def test_map_reduce_combines(spark):
    df = spark.createDataFrame([("a a b",), ("a\tc",), ("",)], "text string")
    got = {r["word"]: r["count"] for r in J.map_reduce(df, J.awk_word_mapper("text"), "word string, count long",
                                                       "word", "count").collect()}
    assert got == {"a": 3, "b": 1, "c": 1}


def test_mapper_gets_bounded_pieces(spark):
    import pandas as pd
    df = spark.range(0, 400, 1, 8).selectExpr("id", "if(id % 7 = 0, null, repeat(concat('w', id % 3, repeat('x', 45), '\\n \\t'), 3000)) as text")

    def mapper(pdf):
        assert list(pdf.index) == list(range(len(pdf)))
        return pd.DataFrame({"k": ["bytes", *pdf["id"].astype(str)], "n": [pdf["text"].dropna().str.len().sum(), *[0] * len(pdf)]})

    got = {r["k"]: r["n"] for r in J.map_reduce(df, mapper, "k string, n long", "k", "n", "max").collect()}
    assert 0 < got.pop("bytes") <= (2 << 20) + 150_000      # a batch has 50 rows of 150,000 bytes
    assert sorted(map(int, got)) == list(range(400))            # no row is lost between pieces
    out = J.map_reduce(df, J.awk_word_mapper("text"), "word string, count long", "word", "count")
    want = {f"w{k}{'x' * 45}": 3000 * sum(1 for i in range(400) if i % 7 and i % 3 == k) for k in range(3)}
    assert {r["word"]: r["count"] for r in out.collect()} == want
    every = J.map_reduce(df, lambda pdf: pd.DataFrame({"k": pdf["id"] % 3, "n": pdf["id"]}), "k long, n long", "k", "n",
                         reduce=lambda values: int(values.sum()))
    assert {r["k"]: r["n"] for r in every.collect()} == {k: sum(range(k, 400, 3)) for k in range(3)}


def test_word_count_tokenizer(spark):
    df = spark.createDataFrame([(" x\ty\r\nx ",)], "text string")
    assert {r["word"]: r["count"] for r in J.word_count(df, "text").collect()} == {"x": 2, "y": 1}


def test_filter_action_missing(spark):
    with pytest.raises(NotImplementedError):
        UD.apply_filter_action(spark.range(1), {}, "images")


def test_gen_rows_deterministic(spark):
    a = J.gen_rows(spark, 1000, 3).orderBy("id").collect()
    b = J.gen_rows(spark, 1000, 7).orderBy("id").collect()
    assert a == b and len({r["key"] for r in a}) == 1000


def test_expand_id_array_keeps_order_and_nulls(spark):
    from cirrus.operators.enrich import expand_id_array
    owners = spark.createDataFrame([(1, [3, 99, 2])], "o int, ids array<int>")
    recs = spark.createDataFrame([(2, "two"), (3, "three")], "id int, name string")
    r = expand_id_array(owners, "o", "ids", recs, "id", "recs").first()["recs"]
    assert [x["name"] if x else None for x in r] == ["three", None, "two"]


def test_bucketed_tables_join_without_shuffle(spark, sf_small):
    from cirrus.sources.files import save_bucketed
    from cirrus.sources.tables import Tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = Tables(spark, sf_small)
        o = save_bucketed(t.orders.select("o_orderkey", "o_custkey"), "orders_b", "o_orderkey", 8)
        li = save_bucketed(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity"),
                           "lineitem_b", "o_orderkey", 8)
        j = o.join(li, "o_orderkey")
        plan = plan_text(j).split("\n\n")[0]
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == t.lineitem.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# Address cases: each form the rule allows, then each way to break it.
V4_NETS = ["7.7.7.7/0", "99.100.249.255/32", "64/3", "12.0/9", "1.2.3/24", "203.0.113.9"]
V4_BROKEN = ["7.7.7.7/33", "7.7.7.256/8", "7.7.7.7.7/8", "7.7.7.7/", "7.7.7.7/x", "/8", "7..7.7/8", "07.7.7.7/8", "7.7.7.7/8/8", "", None]
V6_NETS = ["::/0", "2001:db8:5::9/64", "fd00:1:2:3:4:5:6:7/128", "::198.51.100.3/96", "64:ff9b::203.0.113.1/127", "ABCD::/1"]
V6_BROKEN = ["::/129", "1:2:3:4:5:6:7/8", "1::2::3/8", "12345::/8", "g::/8", "1:2:3:4:5:6:7:8:9/8", "::1/", ":::/8"]


def test_ip_validation_literals(spark):
    from cirrus.operators import quality as Q

    def check(values, **kw):
        return one(spark, Q.valid_ip(F.col("x"), **kw), rows=[(v,) for v in values])

    both = Q.IPV4 | Q.IPV6
    assert all(check(V4_NETS, version=Q.IPV4, mask=True)) and all(check(V6_NETS, version=Q.IPV6, mask=True))
    assert all(check(V4_NETS + V6_NETS, version=both, mask=True))
    assert not any(check(V4_BROKEN + V6_NETS, version=Q.IPV4, mask=True))
    assert not any(check(V6_BROKEN + V4_NETS, version=Q.IPV6, mask=True))
    assert not any(check(V4_BROKEN + V6_BROKEN, version=both, mask=True))
    assert check(["5.6.7.8", "5.6.7", "5.6.7.8/8", "fd::1", "fd::1/8"], version=both) == [True, False, False, True, False]
    assert check(["5.6.7.8/11", "5.6.7.8/12", "fd::/11", "fd::/12"], version=both, mask=True, min_mask=12) == [False, True, False, True]


def test_id_conditions_single_overrides_list():
    conds = TB.id_conditions(singles={"user_id": "u1", "project_id": None},
                             lists={"user_id": ["a", "b"], "project_id": ["p1", "p2"]})
    assert [(c["field"], c["value"]) for c in conds] == [("user_id", "u1"), ("project_id", "p1"), ("project_id", "p2")]
    assert TB.range_conditions("ts", None, "x") == [{"field": "ts", "op": "le", "value": "x"}]


def test_ownership_categories(spark):
    df = spark.createDataFrame([(True, "me"), (True, "other"), (False, "other"), (False, "t2"), (True, "t2")],
                               "pub boolean, owner string")
    got = [r[0] for r in df.select(TB.ownership_categories(F.col("pub"), F.col("owner"), "me", ["t2"])).collect()]
    assert got == [["public", "project"], ["public"], ["shared"], ["t2"], ["public", "t2"]]


# Quota cases: within, at, above, unlimited (-1 and null), never tallied.
QUOTA_LIMITS = {"instances": 6, "cores": 24, "ram": 4000, "volumes": 3, "gigabytes": -1, "fixed_ips": None, "network": 4}
QUOTA_TALLIES = {"instances": 5, "cores": 24, "ram": 4500, "volumes": 0, "gigabytes": 77, "fixed_ips": 12}
QUOTA_EXPECTED = {"instances": {"quota": 6, "used": 5, "available": 1}, "cores": {"quota": 24, "used": 24, "available": 0},
                  "ram": {"quota": 4000, "used": 4500, "available": 0}, "volumes": {"quota": 3, "used": 0, "available": 3},
                  "gigabytes": {"quota": INF, "used": 77, "available": INF},
                  "fixed_ips": {"quota": INF, "used": 12, "available": INF}, "network": {"quota": 4}}


def _usages(spark, limits, tallies):
    q = spark.createDataFrame([("t", k, v) for k, v in limits.items()], "owner string, name string, limit bigint")
    t = spark.createDataFrame([("t", k, v) for k, v in tallies.items()], "owner string, name string, value bigint")
    out = {}
    for r in QU.quota_usage(q, t).collect():
        out[r["name"]] = {k: r[k] for k in ("quota", "used", "available") if r[k] is not None}
    return out


def test_quota_usages(spark):
    assert _usages(spark, QUOTA_LIMITS, QUOTA_TALLIES) == QUOTA_EXPECTED
    assert _usages(spark, {"ram": 10}, {"ram": None}) == {"ram": {"quota": 10, "used": 0, "available": 10}}
    assert _usages(spark, {"ram": 10}, {"cores": 3}) == {"ram": {"quota": 10}}


def test_regex_filter_rejects_bad_pattern(spark):
    df = spark.createDataFrame([("Supplier#15",)], "s string")
    assert TB.filter_regex_row(df, ["s"], "supplier#1[0-9]").count() == 1
    with pytest.raises(ValueError):
        TB.filter_regex_row(df, ["s"], "supplier#(")


def test_object_listing_matches_filesystem(spark, sf_small):
    """The listing source against a brute-force walk of the written folder."""
    import os
    from cirrus.session import scratch_dir
    from cirrus.sources import files as FS
    from cirrus.sources.tables import Tables
    out = scratch_dir(spark, "listing_test")
    FS.write_partitioned(Tables(spark, sf_small).documents, out, "source")
    got = {(r["name"], r["bytes"]) for r in FS.list_objects(spark, out, glob="*.parquet").collect()}
    root = out[len("file:"):] if out.startswith("file:") else out
    want = set()
    for d, _, files in os.walk(root):
        for f in files:
            if f.endswith(".parquet"):
                p = os.path.join(d, f)
                want.add((os.path.relpath(p, root), os.path.getsize(p)))
    assert got == want and len(want) >= 20


def test_split_valid_tags_first_failing_rule(spark):
    from cirrus.operators import quality as Q
    df = spark.createDataFrame([(80, 6), (-1, -1), (-2, 6), (65536, 300), (22, 256), (None, 1)], "port int, proto int")
    rules = {"port": Q.valid_port(F.col("port")), "protocol": Q.valid_protocol(F.col("proto"))}
    ok, bad = Q.split_valid(df, rules)
    assert sorted(r["port"] for r in ok.collect()) == [-1, 80]
    assert sorted(((r["port"] or 0), r["reject_reason"]) for r in bad.collect()) == [
        (-2, "port"), (0, "port"), (22, "protocol"), (65536, "port")]


def test_port_text(spark):
    from cirrus.operators import quality as Q
    good, bad = ["0", "-1", "65535", "7:9", "9:7", "-1:65535"], ["", "x", "1:", ":1", "1:2:3", "65536", "5:-2", "1.5", None]
    got = one(spark, Q.valid_port_text(F.col("x")), rows=[(v,) for v in good + bad])
    assert got == [True] * len(good) + [False] * len(bad)



# Usage records in the nested shape of the service.
def _usage_record(tenant, servers):
    rows = [dict(memory_mb=m, uptime=u, started_at=None, ended_at=None, name=f"n{i}", tenant_id=tenant, state=st, hours=u / 3600,
                 vcpus=c, flavor="f", local_gb=g) for i, (m, u, st, c, g) in enumerate(servers)]
    hours = sum(r["hours"] for r in rows)
    return (tenant, 1.5 * hours, 2 * hours, hours, 0.25 * hours, rows)


USAGE_RECORD_SCHEMA = ("tenant_id string, total_memory_mb_usage double, total_vcpus_usage double, total_hours double, "
                       "total_local_gb_usage double, server_usages array<struct<memory_mb:bigint, uptime:bigint, "
                       "started_at:string, ended_at:string, name:string, tenant_id:string, state:string, hours:double, "
                       "vcpus:bigint, flavor:string, local_gb:bigint>>")


def test_usage_record_summary(spark):
    from cirrus.operators import usage as U
    recs = spark.createDataFrame([_usage_record("a", [(256, 7200, "active", 2, 5), (512, 3600, "active", 1, 7)]),
                                  _usage_record("b", [(1024, 36000, "active", 4, 1)])], USAGE_RECORD_SCHEMA)
    per = {r["tenant_id"]: r.asDict() for r in U.record_summary(recs).collect()}
    assert per["a"] == {"tenant_id": "a", "instances": 2, "memory_mb": 768, "vcpus": per["a"]["vcpus"],
                        "vcpu_hours": 3.0, "local_gb": 12, "disk_gb_hours": 0.75}
    total = U.add_summaries(U.record_summary(recs)).first()
    assert (total["instances"], total["memory_mb"], total["local_gb"]) == (3, 1792, 13)
    assert math.isclose(total["vcpus"], per["a"]["vcpus"] + per["b"]["vcpus"])


def test_truncation(spark):
    out = one(spark, D.truncate_text(F.col("x"), 12), rows=[("exactly 12 c",), ("thirteen char",), (None,)])
    assert out == ["exactly 12 c", "thirteen ...", None]



def test_series_point_from_statistic(spark):
    """A statistic (avg 4.55, ends 2012-12-21T11:00:55.x) becomes the chart point
    ('2012-12-21T11:00:55', 4.55)."""
    from cirrus.operators import metering as M
    st = spark.createDataFrame([("r1", dt.datetime(2012, 12, 21, 11, 0, 55, 123000), 4.55)],
                               "resource string, duration_end timestamp_ntz, avg double")
    p = M.series_points(st, "resource").first()["points"]
    assert [(x["x"], x["y"]) for x in p] == [("2012-12-21T11:00:55", 4.55)]


def test_resolve_endpoint_both_catalogue_shapes(spark):
    from cirrus.operators import enrich as EN
    v3 = spark.createDataFrame([
        ("compute", "compute", "r2", "public", "http://c-r2", 1), ("compute", "compute", "r1", "internal", "http://c-i", 2),
        ("compute", "compute", "r1", "public", "http://c-p", 3), ("identity", "identity", "r9", "public", "http://id", 4),
        ("volume", "volume", "r1", "internal", "http://v-i", 5)],
        "service string, stype string, region string, iface string, url string, s_suppkey int")
    got = {r["service"]: r["url"] for r in EN.resolve_endpoint(v3, "service", "r1", "public", "internal").collect()}
    assert got == {"compute": "http://c-p", "identity": "http://id", "volume": "http://v-i"}
    v2 = spark.createDataFrame([
        ("compute", "compute", "r2", "http://a-pub", "http://a-int", "http://a-adm", 1),
        ("compute", "compute", "r1", None, "http://b-int", "http://b-adm", 2),
        ("compute", "compute", "r1", "http://c-pub", None, None, 3),
        ("identity", "identity", "r9", "http://id-pub", None, None, 4)],
        "service string, stype string, region string, publicURL string, internalURL string, adminURL string, pos int")
    got = {r["service"]: r["url"] for r in EN.resolve_endpoint_typed(v2, "service", "r1", "publicURL",
                                                                       "internalURL").collect()}
    assert got == {"compute": "http://b-int", "identity": "http://id-pub"}


def test_time_range_prunes_day_partitions(spark, sf_small):
    from cirrus.session import scratch_dir
    from cirrus.sources.tables import Tables
    e = Tables(spark, sf_small).events
    path = scratch_dir(spark, "events_by_day")
    e.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(path)
    part = spark.read.parquet(path)
    lo, hi = "2024-01-05 00:00:00", "2024-01-07 12:00:00"
    got = part.where(TB.time_range_predicate(part, "ts", lo, hi)).select("event_id")
    plan = plan_text(got)
    assert "PartitionFilters: [isnotnull(day" in plan and "day#" in plan.split("PartitionFilters:")[1].split("\n")[0]
    want = e.where(TB.time_range_predicate(e, "ts", lo, hi)).select("event_id")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_hidden_quota_names(spark):
    names = [*QU.COMPUTE_QUOTA_FIELDS, *QU.VOLUME_QUOTA_FIELDS, *QU.NETWORK_QUOTA_FIELDS]
    usage = spark.createDataFrame([("t", n) for n in names], "owner string, name string")

    def left(**settings):
        rows = [(*k.split("_"), v) for k, v in settings.items()]
        out = QU.hide_disabled(usage, spark.createDataFrame(rows, "service string, setting string, value boolean"))
        return {r["name"] for r in out.collect()}

    gone = set(names) - left(volume_enabled=False, network_enabled=False)
    assert gone == {*QU.VOLUME_QUOTA_FIELDS, *QU.NETWORK_QUOTA_FIELDS}
    gone = set(names) - left(volume_enabled=True, network_enabled=True, network_groups=False, network_quotas=True)
    assert gone == {"floating_ips", "fixed_ips", "security_group", "security_group_rule"}
    assert not {"security_groups", "port"} & left(network_enabled=True, network_groups=True, network_quotas=False)



def test_title_case(spark):
    got = one(spark, D.label_case(F.col("x")), rows=[("server-one",), ("it's_a 2ND (try)",), ("A:b_C",), ("\u00c9TAT",), ("",), (None,)])
    assert got == ["Server-One", "It's A 2nd (Try)", "A:B C", "\u00c9tat", "", None]


def test_rule_text_takes_empty_as_absent(spark):
    df = spark.createDataFrame([("", "9.0.0.0/8"), ("", ""), ("g", ""), (None, None)], "g string, c string")
    got = [r[0] for r in df.select(D.rule_text(F.lit("IPv4"), F.lit("tcp"), F.lit(5), F.lit(5), F.lit("ingress"), F.col("g"), F.col("c"))).collect()]
    assert [x.rsplit(" ", 1)[1] for x in got] == ["9.0.0.0/8", "ANY", "g", "ANY"]


def test_losing_the_own_admin_role_blocks_all_revokes(spark):
    from cirrus.operators import enrich as EN
    current = spark.createDataFrame([(1, "Admin"), (1, "member"), (2, "admin"), (2, "audit"), (3, "x")], "user_id int, role string")
    want = spark.createDataFrame([(1, "audit"), (2, "audit"), (3, "x")], "user_id int, role string")
    got = {(r["user_id"], r["role"]): r["action"] for r in EN.diff_grants(want, current, 1, "admin").collect()}
    assert got == {(1, "audit"): "add", (1, "Admin"): "blocked", (1, "member"): "blocked", (2, "admin"): "revoke"}
    kept = EN.diff_grants(current.where("role <> 'member'"), current, 1, "admin").collect()
    assert [tuple(r) for r in kept] == [(1, "member", "revoke")]


def test_null_keys_are_reduced(spark):
    import pandas as pd
    df = spark.createDataFrame([("a",), (None,), ("a",), (None,)], "k string")
    out = J.map_reduce(df, lambda pdf: pd.DataFrame({"k": pdf["k"], "n": 1}), "k string, n long", "k", "n")
    assert {r["k"]: r["n"] for r in out.collect()} == {"a": 2, None: 2}


def test_many_meters_become_columns(spark):
    from cirrus.operators import metering as M
    names = [f"m.{i}" for i in range(1500)]
    df = spark.range(3000).selectExpr("id % 2 as resource", "concat('m.', id % 1500) as meter", "double(id) as volume",
                                      "timestamp_ntz'2024-01-01' as ts")
    wide = M.meters_wide(df, "resource", "meter", names)
    assert len(wide.columns) == 1501 and wide.count() == 2


def test_carriage_returns_stay_in_lines(spark):
    from cirrus.session import scratch_dir
    from cirrus.sources import files as FS
    path = scratch_dir(spark, "cr")
    FS.write_text(spark.createDataFrame([("a\rb",), ("c",)], "t string"), "t", path)
    assert sorted(r["value"] for r in FS.read_text(spark, path).collect()) == ["a\rb", "c"]


def test_lists_above_the_bound_fail(spark):
    from cirrus.operators import enrich as EN
    df = spark.range(10).selectExpr("id % 2 as k", "id")
    got = df.groupBy("k").agg(EN.collect_list(F.col("id"), most=5).alias("x"))
    assert sorted(sorted(r["x"]) for r in got.collect()) == [[0, 2, 4, 6, 8], [1, 3, 5, 7, 9]]
    with pytest.raises(Exception, match="a list above 4 items: 5"):
        df.groupBy("k").agg(EN.collect_list(F.col("id"), most=4).alias("x")).collect()


def test_user_reducer_program(spark):
    import pandas as pd
    df = spark.range(0, 4000, 1, 7).selectExpr("if(id % 3 = 0, 'hot', cast(id % 50 as string)) as k", "id")
    out = J.map_reduce(df, lambda pdf: pd.DataFrame({"k": pdf["k"], "n": pdf["id"]}), "k string, n long", "k", "n",
                       reduce=lambda values: int(values.max() ^ 0))
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.max("id").alias("m")).collect()}
    assert {r["k"]: r["n"] for r in out.collect()} == want
