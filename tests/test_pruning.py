"""Filters and look-ups that read part of a table: trigram postings, bloom filters, ordered pages."""

import random

import pytest
from pyspark.sql import functions as F

from cirrus.operators import page_index as PI
from cirrus.operators import table as TB
from cirrus.operators import text_index as TI
from cirrus.session import scratch_dir
from cirrus.sources.files import save_clustered


def scan_metric(df, name):
    """(result rows, a metric summed over the file scans of the run that gave them)."""
    rows = [tuple(r) for r in df.collect()]
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif node.nodeName().startswith("Scan parquet"):
            wanted = node.metrics().get(name)
            if "grp" in node.schema().simpleString() or name != "numFiles":
                total += wanted.get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sorted(rows, key=str), total


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(5)
    syllables = ["ka", "Lo", "mi", "RU", "te", "zo", "é", "_", "%", "日本", "𝒳", "ﬀ"]
    rows = [(k, "".join(rng.choice(syllables) for _ in range(rng.randrange(9))) or None, rng.choice(["ring", "Bolt ", None, "", "xx"]))
            for k in range(2000)]
    rows += [(5000, "needle in here", "Bolt "), (5001, "the same row", "ring"), (5001, "the same row", "ring")]
    return spark.createDataFrame(rows, "id long, name string, kind string")


def test_postings_give_the_rows_of_the_scan(spark, names):
    index = TI.build(names, ["name", "kind"], ["name", "id"], scratch_dir(spark, "grams"), groups=24)
    for terms in (["KALO"], ["needle", "ring"], ["lo"], [""], ["日本日"], ["𝒳ka"], ["é_%"], ["absent words"], ["same ROW"]):
        got, _ = scan_metric(index.contains_any(["name", "kind"], *terms), "numFiles")
        want = names.where(" or ".join(f"contains(lower({c}), lower('{t}'))" for c in ("name", "kind") for t in terms))
        assert got == sorted(map(tuple, want.collect()), key=str), terms
    for pattern in ("ka*RU", "*", "needle*HERE", "Lomi*te*zo ignored", "%*_ka", "row*same"):
        got, _ = scan_metric(index.wildcard("name", pattern), "numFiles")
        assert got == sorted(map(tuple, TB.filter_wildcard(names, "name", pattern).collect()), key=str), pattern


def test_postings_prune_the_scan(spark, names):
    index = TI.build(names, ["name", "kind"], ["name", "id"], scratch_dir(spark, "grams"), groups=24)
    found, files = scan_metric(index.contains_any(["name"], "needle"), "numFiles")
    assert [r[0] for r in found] == [5000] and files == 1
    assert scan_metric(index.contains_any(["name"], "lo"), "numFiles")[1] >= 20      # under three characters: all


def test_postings_of_an_empty_table_and_a_taken_name(spark, names):
    index = TI.build(names.limit(0), ["name"], ["name"], scratch_dir(spark, "grams"), groups=4)
    assert index.contains_any(["name"], "needle").collect() == []
    with pytest.raises(ValueError, match="grp"):
        TI.build(names.withColumn("grp", F.lit(1)), ["name"], ["name"], scratch_dir(spark, "grams"))


def test_point_lookups_skip_row_groups(spark):
    table = spark.range(40_000).select((F.col("id") * 7919 % 40_009).alias("key"), (F.col("id") / 10).cast("int").alias("day"),
                                       F.sha2(F.col("id").cast("string"), 256).alias("name"))
    laid = save_clustered(table, scratch_dir(spark, "clustered"), ["day", "key"], ["key", "name"], files=4, group_rows=1000)
    want = [tuple(r) for r in table.where("key = 7919").collect()]
    got, rows = scan_metric(TB.lookup_points(laid, "key", ["7919", "no number", "99999999"]), "numOutputRows")
    assert got == want and rows <= 5000             # one row group, and at most a few that the filter mistakes
    name = want[0][2]
    got, rows = scan_metric(TB.lookup_points(laid, "name", [name, "absent"]), "numOutputRows")
    assert got == want and rows <= 5000
    assert TB.lookup_points(laid, "key", []).collect() == []
    with pytest.raises(Exception, match="several rows for day"):
        TB.lookup_points(laid, "day", [5]).collect()


def test_indexed_pages_make_up_the_full_sort(spark):
    rows = [(k // 90, k, f"v{k}") for k in range(700)]
    frame = spark.createDataFrame(random.Random(1).sample(rows, 700), "a long, b long, v string").repartition(5)
    index = PI.build(frame, ["a", "b"], scratch_dir(spark, "pages"), ranges=8)
    for backward in (False, True):
        marker, pages = None, []
        while True:
            page = [tuple(r) for r in index.around(marker, 50, backward).collect()]
            pages.append([p[:3] for p in page])
            if not page[0][3]:
                break
            marker = pages[-1][0 if backward else -1][:2]
        assert [x for p in (reversed(pages) if backward else pages) for x in p] == rows and len(pages) == 14
    assert [tuple(r)[:3] for n in range(15) for r in index.numbered(n, 50).collect()] == rows
    assert index.around((0, 0), 50, True).collect() == [] and index.around((99, 0), 50).collect() == []
    # a page longer than any range takes several
    assert [tuple(r)[:3] for r in index.around((0, 5), 400).collect()] == rows[6:406]


def test_a_deep_page_reads_two_ranges(spark):
    frame = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    index = PI.build(frame, ["id"], scratch_dir(spark, "pages"), ranges=16)
    for df in (index.around([15_123], 50), index.around([15_123], 50, True), index.numbered(300, 50)):
        rows, files = scan_metric(df, "numFiles")
        assert len(rows) == 50 and 1 <= files <= 2
    assert PI.build(frame.limit(0), ["id"], scratch_dir(spark, "pages"), ranges=4).around(None, 5).collect() == []
