"""Byte ranges of growing logs and tails read backwards."""

from __future__ import annotations

import io
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cirrus.session import make_dir, scratch_dir
from cirrus.sources import log_files as LF
from cirrus.streaming import jobs as SJ


def local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def add(folder, name, data, mode="ab"):
    with open(os.path.join(local(folder), name), mode) as f:
        f.write(data)


class Counted(io.BytesIO):
    got = 0

    def read(self, size=-1):
        data = super().read(size)
        self.got += len(data)
        return data


@settings(max_examples=200, deadline=None)
@given(st.text("ab\n", max_size=60), st.integers(1, 9), st.integers(1, 7))
def test_blocks_give_each_complete_line_once(text, block, chunk):
    data = text.encode()
    old, LF.CHUNK = LF.CHUNK, chunk
    try:
        got = [row for at in range(0, len(data), block)
               for row in LF.lines_between(io.BytesIO(data), at, min(at + block, len(data)), len(data), at == 0)]
    finally:
        LF.CHUNK = old
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, at + len(line) + 1, line))
        at += len(line) + 1
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab\n", max_size=60), st.integers(0, 9), st.integers(1, 7))
def test_tail_equals_the_last_lines(text, n, chunk):
    data = text.encode()
    old, LF.TAIL_CHUNK = LF.TAIL_CHUNK, chunk
    try:
        got = LF.tail_lines(io.BytesIO(data), len(data), n)
    finally:
        LF.TAIL_CHUNK = old
    lines = data.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    assert [line for _, line in got] == (lines[-n:] if n else [])
    assert all(data[s:s + len(line)] == line for s, line in got)


@pytest.mark.parametrize("lines", [1_000, 200_000])
def test_tail_reads_the_same_of_any_length(lines):
    data = b"".join(b"line %07d\n" % i for i in range(lines))
    file = Counted(data)
    got = LF.tail_lines(file, len(data), 35)
    assert [int(line[5:]) for _, line in got] == list(range(lines - 35, lines))
    assert file.got <= LF.TAIL_CHUNK


def test_tail_files_equals_the_window(spark):
    src = make_dir(spark, scratch_dir(spark, "tail_src"))
    texts = {"a.log": "\n".join(f"a{i}" for i in range(100)), "b c%.log": "x\n\ny\n", "empty.log": "", "é.log": "ü\nö\n"}
    for name, text in texts.items():
        add(src, name, text.encode())
    got = {}
    for r in LF.tail_files(LF.list_files(spark, src), 35).orderBy("path", F.desc("from_end")).collect():
        got.setdefault(os.path.basename(r["path"]), []).append(r["value"])
    assert got == {"a.log": [f"a{i}" for i in range(65, 100)], "b c%.log": ["x", "", "y"], "é.log": ["ü", "ö"]}


def test_appended_ranges(spark, monkeypatch):
    src = make_dir(spark, scratch_dir(spark, "grow_src"))
    dest, manifest = scratch_dir(spark, "grow_dest"), scratch_dir(spark, "grow_manifest")

    def now():
        rows = SJ.read_appended(spark, dest, manifest).orderBy("path", "start").collect()
        return [(os.path.basename(r["path"]), r["value"]) for r in rows]

    def round_no(n):
        return {os.path.basename(r["path"]): r["taken"] for r in SJ.sync_appended(spark, src, dest, manifest, n).collect()}

    add(src, "a.log", b"one\ntwo\nthr")
    add(src, "b.log", b"x\n")
    add(src, "empty.log", b"")
    assert round_no(0) == {"a.log": 8, "b.log": 2}                  # the line that has not ended waits
    assert now() == [("a.log", "one"), ("a.log", "two"), ("b.log", "x")]
    add(src, "a.log", b"ee\nfour\n")
    assert round_no(1) == {"a.log": 19}
    lines = spark.read.parquet(f"{dest}/run=1").orderBy("start").collect()
    assert [(r["start"], r["value"]) for r in lines] == [(8, "three"), (14, "four")]      # only what was appended
    assert round_no(1) == {"a.log": 19} and len(now()) == 5         # a round run again replaces itself
    assert round_no(2) == {}
    add(src, "b.log", b"", mode="wb")
    assert round_no(3) == {}
    add(src, "a.log", b"new\n", mode="wb")                          # shorter: begun anew
    assert round_no(4) == {"a.log": 4}
    assert now() == [("a.log", "new"), ("b.log", "x")]
    # a round that dies after copying leaves nothing to readers, and its repetition nothing twice
    add(src, "a.log", b"more\n")
    ranges = spark.createDataFrame([(f"{src}/a.log", 4, 9)], "path string, first long, last long")
    LF.read_lines(ranges).write.parquet(f"{dest}/run=5")
    assert now() == [("a.log", "new"), ("b.log", "x")]
    assert round_no(5) == {"a.log": 9}
    assert now() == [("a.log", "new"), ("a.log", "more"), ("b.log", "x")]


def test_a_long_file_is_read_in_blocks(spark):
    src = make_dir(spark, scratch_dir(spark, "block_src"))
    want = [f"{i} " + "y" * (i % 50) for i in range(5000)]
    add(src, "hot.log", ("\n".join(want) + "\n").encode())
    ranges = LF.list_files(spark, src).select("path", F.lit(0).cast("long").alias("first"), F.col("bytes").alias("last"))
    got = LF.read_lines(ranges, block=1000).withColumn("task", F.spark_partition_id())
    assert [r["value"] for r in got.orderBy("start").collect()] == want
    assert got.select("task").distinct().count() > 1
