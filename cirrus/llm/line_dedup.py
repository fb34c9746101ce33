"""Passages that documents share, removed by pairwise line alignment.

Every shortest run of lines that has enough words and that more than one document
holds links its later holders to the first one, so a run held by a third of all
documents makes as many links as documents and not their square. A longer passage is
covered by such runs, so each of its lines is met in a pair, however short the lines
are and whoever holds them first one by one. A pair carries the runs that link it and
their places in both documents, no whole line lists, so a document that quotes
thousands of others is still sent once in all.

Each pair is aligned by patience diff over its runs: runs that are rare in both (they
occur once) are matched along the longest rising sequence and grown to blocks, and the
stretches between them are aligned the same way. What an alignment matched is taken
out, further copies of it with it, and the rest is aligned again, forwards or
backwards, until nothing is left, so passages in another order go as well. The lines of aligned
blocks leave the later document; the first holder of a run never loses it to that pair.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.llm.storage import write_table

#: Words that a common block must have to be removed.
MIN_WORDS = 8
#: Documents or pairs whose lines are Python objects at once.
_ROWS = 256


def _once(lines: list, low: int, high: int) -> dict:
    counts = Counter(lines[i][1] for i in range(low, high))
    return {lines[i][1]: i for i in range(low, high) if counts[lines[i][1]] == 1}


def _numbered(lines: list, low: int, high: int) -> dict:
    """Lines by hash and occurrence, for stretches without a line that occurs once."""
    counts: Counter = Counter()
    out = {}
    for i in range(low, high):
        counts[lines[i][1]] += 1
        out[lines[i][1], counts[lines[i][1]]] = i
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (sorted by the first) that also rises in the second."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        if k == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[k], ends[k] = b, i
        back[i] = ends[k - 1] if k else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(later: list, first: list) -> list[tuple[int, int, int]]:
    """Common blocks of two lists of (number, hash, ...) lines, as (index in later,
    index in first, length): hashes agree and the numbers are consecutive in both."""
    matched: dict[int, int] = {}
    todo = [(0, len(later), 0, len(first))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        pairs: list[tuple[int, int]] = []
        for key in (_once, _numbered):
            mine, other = key(later, a, b), key(first, c, d)
            pairs = sorted((i, other[k]) for k, i in mine.items() if k in other)
            if pairs:
                break
        if not pairs:
            continue
        i0, j0 = a, c
        for i, j in [*_rising(pairs), (b, d)]:
            if i < i0 or j < j0:
                continue        # a block grown from the match before holds it
            lo_i, lo_j = i, j
            if i < b:
                while lo_i > i0 and lo_j > j0 and _next(later, lo_i - 1) and _next(first, lo_j - 1) \
                        and later[lo_i - 1][1] == first[lo_j - 1][1]:
                    lo_i, lo_j = lo_i - 1, lo_j - 1
            todo.append((i0, lo_i, j0, lo_j))
            hi_i, hi_j = i, j
            if i < b:
                hi_i, hi_j = i + 1, j + 1
                while hi_i < b and hi_j < d and _next(later, hi_i - 1) and _next(first, hi_j - 1) \
                        and later[hi_i][1] == first[hi_j][1]:
                    hi_i, hi_j = hi_i + 1, hi_j + 1
            matched.update(zip(range(lo_i, hi_i), range(lo_j, hi_j)))
            i0, j0 = hi_i, hi_j
    blocks: list[list[int]] = []
    for i in sorted(matched):
        j = matched[i]
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j \
                and _next(later, i - 1) and _next(first, j - 1):
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    return [tuple(x) for x in blocks]


def _next(lines: list, i: int) -> bool:
    """Whether line i + 1 of the list follows line i in its document."""
    return lines[i][0] + 1 == lines[i + 1][0]


def shortest_runs(lines: list, min_words: int) -> list[tuple[int, int]]:
    """(first, last index) of the shortest runs of consecutive lines (number, hash,
    words, ...) that have ``min_words`` words: from each line on, and up to each line.
    Every line of a longer run is in one of those within it."""
    out, start, words, i = [], 0, 0, 0
    for j, line in enumerate(lines):
        if j and not _next(lines, j - 1):
            start = i = j
            words = 0
        words += line[2]
        if words < min_words and i > start:
            out.append((i - 1, j))
        while words >= min_words and i <= j:
            out.append((i, j))
            words -= lines[i][2]
            i += 1
    return out


def alignments(mine: list, other: list) -> Iterator[list[tuple[int, int]]]:
    """The passes over a pair's runs (number, hash, first line, last line) and the other
    side's (number, hash): each yields the line ranges of the runs that it
    aligned and of their further copies.
    A pass is aligned forwards, and backwards too if that leaves something; of any
    order one of the two matches at least the square root of the runs left."""
    while mine:
        rest, blocks = mine, align(mine, other)
        if sum(n for _, _, n in blocks) < len(mine):
            back = align(mine[::-1], other)
            if sum(n for _, _, n in back) > sum(n for _, _, n in blocks):
                rest, blocks = mine[::-1], back
        if not blocks:
            return
        taken = {rest[k][1] for i, _, n in blocks for k in range(i, i + n)}
        yield [(x[2], x[3]) for x in mine if x[1] in taken]
        mine = [x for x in mine if x[1] not in taken]


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of lines in order; those that overlap or touch are joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that few lines are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _rows(part: pa.RecordBatch, of: list[int], *more: pa.Array) -> list[pa.Array]:
    at = pa.array(of, pa.int64())
    return [part.column("id").take(at), part.column("v").take(at), *more]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        of, spans = [], []
        for row, links in enumerate(part.column("links").to_pylist()):
            mine = sorted((x["n"], link["k"], x["a"], x["b"]) for link in links for x in link["mine"])
            other = sorted((n, link["k"]) for link in links for n in link["other"])
            found = joined_spans([x for blocks in alignments(mine, other) for x in blocks])
            if found:
                of.append(row)
                spans.append([{"a": a, "b": b} for a, b in found])
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        yield pa.RecordBatch.from_arrays(_rows(part, of, pa.array(spans, kind)), names=["id", "v", "spans"])


def runs_of(lines: list, min_words: int) -> dict[bytes, list[tuple[int, int, int]]]:
    """The shortest runs of lines (number, hash, words, place) by a 128-bit hash: each
    one's number in the document and the places of its first and last lines. Numbers
    skip one where lines part, so that no block reaches over the gap."""
    out: dict[bytes, list[tuple[int, int, int]]] = {}
    n, end = 0, -1
    for i, j in sorted(shortest_runs(lines, min_words)):
        n += 1 + (end >= 0 and i > end and not all(_next(lines, x) for x in range(end, i)))
        end = j
        key = lines[i][1] if i == j else md5(b"".join(x[1] for x in lines[i:j + 1])).digest()
        out.setdefault(key, []).append((n, lines[i][3], lines[j][3]))
    return out


def _runs(min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v, k, mine): a document's shortest runs, a row for each hash."""
    kind = pa.list_(pa.struct([("n", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))
    for part in _slices(batches):
        of, keys, places = [], [], []
        for row, lines in enumerate(part.column("lines").to_pylist()):
            mine = runs_of([(x["n"], x["h"], x["w"], x["at"]) for x in lines], min_words)
            of += [row] * len(mine)
            keys += mine
            places += [[{"n": n, "a": a, "b": b} for n, a, b in x] for x in mine.values()]
        yield pa.RecordBatch.from_arrays(_rows(part, of, pa.array(keys, pa.binary()), pa.array(places, kind)),
                                         names=["id", "v", "k", "mine"])


def _lines(text: Column) -> Column:
    """Lines (at: place, h: 128-bit hash without the outer white space, w: words)."""
    return F.transform(F.split(text, "\n"), lambda x, i: F.struct(
        i.alias("at"), F.unhex(F.md5(F.trim(x).cast("binary"))).alias("h"),
        F.size(F.filter(F.split(x, r"[ \t\x0B\f\r]+"), lambda y: y != "")).alias("w")))


def shared_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """(id, v, spans): for each document (v is the hash of its text) that shares a block
    with an earlier one, the (a, b) ranges of its lines to remove."""
    text = F.col(text_col)
    # number lines that are not blank, so that blank ones don't part a block
    lines = (docs.where(F.col(id_col).isNotNull() & text.isNotNull())
             .select(F.col(id_col).alias("id"), F.xxhash64(text).alias("v"), F.filter(_lines(text), lambda x: x["w"] > 0).alias("l"))
             .select("id", "v", F.posexplode("l").alias("n", "x"))
             .select("id", "v", "n", F.col("x.h").alias("h"), F.col("x.w").alias("w"), F.col("x.at").alias("at")))
    lines, _ = write_table(lines, "lines")
    holder = F.struct("id", "v")

    # what one document alone holds is of no use
    held_twice = (lines.groupBy("h").agg(F.min(holder).alias("first"), F.max(holder).alias("last"))
                  .where("first <> last").select(F.col("h").alias("same")))
    shared = lines.join(held_twice, F.reverse("h") == F.reverse("same")).drop("same").distinct()
    # a document's own lines, in one row: never more than its text
    held = shared.groupBy("id", "v").agg(F.sort_array(F.collect_list(F.struct("n", "h", "w", "at"))).alias("lines"))
    kind = lines.schema["id"].dataType.simpleString()
    runs, _ = write_table(held.mapInArrow(lambda batches: _runs(min_words, batches),
                                          f"id {kind}, v long, k binary, mine array<struct<n:int,a:int,b:int>>"), "runs")
    # the first holder is the smallest (id, v); its places in the document come along
    first = (runs.groupBy("k").agg(F.min(F.struct("id", "v", F.col("mine.n").alias("other"))).alias("first"), F.max(holder).alias("last"))
             .where((F.col("first.id") != F.col("last.id")) | (F.col("first.v") != F.col("last.v")))
             .select(F.col("k").alias("same"), "first"))
    links = (runs.join(first, F.reverse("k") == F.reverse("same"))
             .where(holder > F.struct(F.col("first.id"), F.col("first.v")))
             .groupBy("id", "v", F.col("first.id").alias("fid"), F.col("first.v").alias("fv"))
             .agg(F.collect_list(F.struct("k", "mine", F.col("first.other").alias("other"))).alias("links")))
    found = links.select("id", "v", "links").mapInArrow(_aligned, f"id {kind}, v long, spans array<struct<a:int,b:int>>")
    return found.groupBy("id", "v").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def remove_shared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with common blocks removed from the text of later documents, and two
    columns more: ``lines_removed`` and ``words_removed``.

    Documents are in the order of their ids (then of their texts' hashes); a block is a
    run of equal lines (blank ones aside, outer spaces aside) of at least
    ``min_words`` words in all. The first holder keeps each line. Rows that repeat an
    id and a text are one document and come out alike. Null texts, null ids and texts
    that share nothing are as they were; a copy of an earlier document is left empty.
    """
    blocks = shared_blocks(docs, id_col, text_col, min_words).select(
        F.col("id").alias("_block_id"), F.col("v").alias("_block_v"), F.col("spans").alias("_spans"))
    text = F.col(text_col)
    joined = docs.join(blocks, (F.col(id_col) == F.col("_block_id")) & (F.xxhash64(text) == F.col("_block_v")), "left")
    gone = lambda i: F.exists("_spans", lambda s: (i >= s["a"]) & (i <= s["b"]))
    lines = F.split(text, "\n")
    kept = F.when(F.col("_spans").isNull(), text).otherwise(F.concat_ws("\n", F.filter(lines, lambda x, i: ~gone(i))))
    taken = F.when(F.col("_spans").isNull(), F.lit("")).otherwise(
        F.concat_ws("\n", F.filter(lines, lambda x, i: gone(i))))
    words = F.size(F.filter(F.split(taken, r"[ \t\x0B\f\r\n]+"), lambda y: y != ""))
    full = F.size(F.filter(F.split(taken, "\n"), lambda y: F.trim(y) != ""))
    others = [c for c in docs.columns if c not in ("lines_removed", "words_removed")]
    return joined.select(*[kept.alias(c) if c == text_col else F.col(c) for c in others],
                         full.alias("lines_removed"), words.alias("words_removed"))
