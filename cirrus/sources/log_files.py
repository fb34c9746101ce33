"""Byte ranges of log files, read on the executors.

Spark's text reader takes whole files. Logs grow at their end, so the readers here seek:
:func:`read_lines` reads the lines of given byte ranges, in blocks that are tasks of their
own, and :func:`tail_files` reads files backwards from their ends. Files are opened
through Arrow's file systems (local, HDFS, S3, Google and Azure stores by the URI's
scheme). Lines end in a line feed; bytes that are not UTF-8 become replacement
characters; a carriage return stays part of its line.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that one work item covers.
BLOCK = 64 << 20
#: Bytes of one read.
CHUNK = 1 << 20
TAIL_CHUNK = 64 << 10
#: Lines of one Arrow batch.
LINES = 4096


def open_file(path: str) -> pa.NativeFile:
    """A seekable file of any store that Arrow knows, from its path as Spark lists it."""
    scheme = urlsplit(path).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(path[len("file:"):] if scheme else path)
    store, inside = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(inside)


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, bytes) of all files below a folder, from metadata alone."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", F.col("length").alias("bytes"))


def lines_between(file, first: int, last: int, end: int, whole: bool) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, line) of the lines that start in [first, last) and whose line feed lies
    before ``end``. Unless ``whole`` is set, ``first`` is inside a file: the line that
    begins there counts only if a line feed stands before it."""
    at = first if whole else first - 1
    file.seek(at)
    buffer, known = bytearray(), whole
    while True:
        more = file.read(min(CHUNK, end - at - len(buffer)))
        # only the new bytes are searched, so a long line costs its length once
        seek, done = len(buffer), 0
        buffer += more
        while (feed := buffer.find(b"\n", max(seek, done))) >= 0:
            if known and at + done >= last:
                return
            if known:
                yield at + done, at + feed + 1, bytes(buffer[done:feed])
            known, done = True, feed + 1
        if not known:                   # inside a line of an earlier block: nothing to keep
            done = len(buffer)
        at += done
        del buffer[:done]
        if not more or at >= last:
            return


def tail_lines(file, size: int, n: int) -> list[tuple[int, bytes]]:
    """(start, line) of the last ``n`` lines of a file of ``size`` bytes, read backwards in
    blocks until ``n`` line feeds are found; a last line without one counts."""
    parts, at, feeds = [], size, 0
    while at > 0 and n > 0 and feeds <= n:
        step = min(TAIL_CHUNK, at)
        at -= step
        file.seek(at)
        parts.append(file.read(step))
        feeds += parts[-1].count(b"\n")
    text = b"".join(reversed(parts))
    lines = text.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    starts, place = [], at
    for line in lines:
        starts.append(place)
        place += len(line) + 1
    return list(zip(starts, lines))[-n:] if n > 0 else []


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows in batches bounded by lines and by bytes of their last column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= LINES or size >= CHUNK * 8:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _range_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for work in batch.to_pylist():
                with open_file(work["path"]) as file:
                    for start, end, line in lines_between(file, work["at"], work["stop"], work["last"], work["at"] == work["first"]):
                        yield work["path"], start, end, line.decode("utf-8", "replace")
    yield from _batches(rows(), ["path", "start", "end", "value"], [pa.string(), pa.int64(), pa.int64(), pa.string()])


def _tails(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for work in batch.to_pylist():
                with open_file(work["path"]) as file:
                    lines = tail_lines(file, work["bytes"], n)
                for k, (start, line) in enumerate(lines):
                    yield work["path"], start, len(lines) - k, line.decode("utf-8", "replace")
    yield from _batches(rows(), ["path", "start", "from_end", "value"], [pa.string(), pa.int64(), pa.int64(), pa.string()])


def _dealt(work: DataFrame, *by: str) -> DataFrame:
    """Work items over as many tasks as the session's shuffles have. The number is
    given, so adaptive execution does not put the short rows into one task."""
    return work.repartition(int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def read_lines(ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, start, end, value): the complete lines of byte ranges (path, first, last).
    A range begins where a line begins; a last line whose line feed is not below
    ``last`` is left out. Long ranges are read in blocks by several tasks."""
    work = (ranges.where("last > first").select("path", "first", "last")
            .withColumn("at", F.explode(F.expr(f"sequence(first, last - 1, {block}L)")))
            .withColumn("stop", F.least(F.col("at") + block, "last")))
    return _dealt(work, "path", "at").mapInArrow(_range_lines, "path string, start long, end long, value string")


def tail_files(files: DataFrame, n: int = 35) -> DataFrame:
    """(path, start, from_end, value): the last ``n`` lines of each file of (path, bytes),
    from_end 1 for the last. What is read depends on the lines, not on the file's length."""
    return _dealt(files.select("path", "bytes"), "path").mapInArrow(
        partial(_tails, n), "path string, start long, from_end long, value string")
