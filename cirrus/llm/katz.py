"""Katz bigram model: Good-Turing discounts, exactly normalised backoff weights.

1. ``chunks``: texts as local word numbers, a few million tokens a row.
2. ``unigrams``: counts by word, brought back to each chunk as the global numbers
   and the training counts of its own words (by the word, then by the chunk). Both are
   written as one table, ``numbered``, and dropped.
3. Chunks are worked on in slices of whole documents. A slice sends each of its distinct
   bigrams once, with how often its training documents hold it and both words' counts,
   packed in a block per context bucket. A bucket holds every block with its contexts'
   bigrams, so it adds up their counts and sums what each context's backoff weight needs.
4. A bucket answers each block with the corpus' counts of its bigrams, in the block's
   order. A chunk's slices are cut again and lay the answers out over their tokens, so a
   document's logarithms are added up in one place, however many buckets there are.
5. Discounts depend on the counts of counts of the whole corpus, which the buckets
   report; they are known when the answers are read. Backoff weights are made of what the
   buckets report about contexts and joined to the tokens that back off.

Per token the model is: log p(w | v) = log(d_r * r / (c(v) + 1)) if the bigram was seen r
times, else log a(v) + log p(w). Every context has one event more than was seen, so that
something is left to back off with where all its counts are above K too. p(w) is
discounted the same way, and the mass that
its discounts free goes to one unknown word. a(v) = (1 - sum of the seen p(w | v)) /
(1 - sum of their p(w)), so every context's probabilities sum to one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirrus.llm.folds import is_fold
from cirrus.llm.storage import drop_table, free_shuffles, write_table

#: Counts up to so many are discounted.
K = 5
#: Tokens of a chunk and (about) of a bucket. A context with more than a LIGHT-th of a
#: bucket's tokens is spread by its second word, so that buckets are of about one size.
CHUNK_TOKENS = 2 << 20
BUCKET_TOKENS = 2 << 20
LIGHT = 8
#: Tokens (about) of a chunk that are worked on at a time.
SLICE_TOKENS = 1 << 20
END = ""


def _pack(columns: list[np.ndarray], squeeze: zstandard.ZstdCompressor) -> bytes:
    """Columns of longs, bytes of one place together, compressed."""
    table = np.stack(columns).astype("<i8")
    return squeeze.compress(np.ascontiguousarray(table.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(blob: bytes, columns: int) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(data.T).view("<i8").reshape(columns, -1)


def _release() -> None:
    """Give the system back what a worker has freed; it lives on, idle, through later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _chunks(size: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = TaskContext.get().partitionId() << 36
    local: dict[bytes, int] = {b"": 0}
    ids, held, lengths, runs, total = [], [], [], [], 0

    def done() -> pd.DataFrame:
        nonlocal number, local, ids, held, lengths, runs, total
        tokens = np.concatenate(runs)
        train = np.bincount(tokens[np.repeat(~np.array(held), lengths)], minlength=len(local))
        frame = pd.DataFrame({
            "chunk": [number], "ids": [ids], "held": [held], "lengths": [lengths],
            "tokens": [zstandard.compress(tokens.astype("<i4").tobytes(), 3)],
            "words": [[w.decode("utf-8", "surrogatepass") for w in local]], "train": [train]})
        number += len(ids)
        local, ids, held, lengths, runs, total = {b"": 0}, [], [], [], [], 0
        return frame

    for batch in batches:
        for key, text, out in zip(batch["id"], batch["text"], batch["held"]):
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            new = set(words).difference(local)
            local.update(zip(new, range(len(local), len(local) + len(new))))
            words.append(b"")
            runs.append(np.fromiter(map(local.__getitem__, words), dtype=np.int32, count=len(words)))
            ids.append(None if pd.isna(key) else key)
            held.append(bool(out))
            lengths.append(len(words))
            total += len(words)
            if total >= size:
                yield done()
                _release()
    if ids:
        yield done()
    _release()


def discounts(of_count: dict[int, int]) -> list[float]:
    """d_1 .. d_K by Good and Turing from the number of events of each count. Where
    the counts of counts are too thin for that (a value outside 0 to 1), half a count
    is taken off."""
    n = [of_count.get(r, 0) for r in range(K + 2)]
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Unigrams:
    """p(w) by count. ``left`` is what the discounts free, the unknown word's share."""

    def __init__(self, of_count: dict[int, int], total: int):
        self.d = discounts(of_count)
        freed = sum(of_count.get(r, 0) * r * (1 - d) for r, d in enumerate(self.d, 1))
        self.total = total + (0 if freed > 0 else 1)
        self.left = (freed if freed > 0 else 1) / self.total

    def p(self, counts: np.ndarray) -> np.ndarray:
        factor = np.array([0.0, *self.d, 1.0])[np.minimum(counts, K + 1)]
        return np.where(counts > 0, factor * counts / self.total, self.left)


def _spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)


class _Slice:
    """Whole documents of a chunk: of each token its document (``row``) and its bigram
    (``of``); of each distinct bigram its local words and their training counts.
    ``order`` has the bigrams that travel by bucket (``bucket``): all but those of a
    context that training has not seen. It is the same whenever a chunk is cut."""

    def __init__(self, buckets: int, heavy: int, row: np.ndarray, tokens: np.ndarray, number: np.ndarray, count: np.ndarray):
        before = np.empty_like(tokens)
        first = np.r_[True, row[1:] != row[:-1]]
        before[1:] = tokens[:-1]
        before[first] = 0                           # each document starts after an end
        pair, self.of = np.unique(before.astype(np.int64) * len(number) + tokens, return_inverse=True)
        self.row, self.tokens = row, tokens
        self.v, self.w = np.divmod(pair, len(number))
        self.cv, self.cw = count[self.v], count[self.w]
        gv = number[self.v]
        place = _spread(gv, np.where(self.cv >= heavy, number[self.w], 0)) % np.uint64(buckets)
        place = place.astype(np.uint16 if buckets < 1 << 16 else np.int64)
        order = np.argsort(place, kind="stable")
        self.order = order[self.cv[order] > 0]
        self.bucket = place[self.order]


def _slices(buckets: int, heavy: int, r) -> Iterator[tuple[int, int, _Slice]]:
    """(first document, documents, slice) of a chunk's row."""
    tokens = np.frombuffer(zstandard.decompress(r.tokens), dtype="<i4")
    lengths = np.asarray(r.lengths, dtype=np.int64)
    number, count = np.asarray(r.numbers, dtype=np.int64), np.asarray(r.counts, dtype=np.int64)
    ends = lengths.cumsum()
    parts = max(1, round(len(tokens) / SLICE_TOKENS))
    a = 0
    for b in np.unique(np.searchsorted(ends, len(tokens) * np.arange(1, parts + 1) // parts) + 1).tolist():
        row = np.repeat(np.arange(b - a, dtype=np.int32), lengths[a:b])
        yield a, b - a, _Slice(buckets, heavy, row, tokens[int(ends[a - 1]) if a else 0:int(ends[b - 1])], number, count)
        a = b


def _blocks(buckets: int, heavy: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of (v, w, n, c(v), c(w)), n as training has it."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for r in batch.itertuples(index=False):
            number, held = np.asarray(r.numbers, dtype=np.int64), np.asarray(r.held, dtype=bool)
            for a, _, s in _slices(buckets, heavy, r):
                n = np.bincount(s.of, ~held[a + s.row], len(s.v)).astype(np.int64)
                starts = np.flatnonzero(np.r_[len(s.order) > 0, s.bucket[1:] != s.bucket[:-1]])
                blobs = []
                for i, j in zip(starts, [*starts[1:], len(s.order)]):
                    at = s.order[i:j]
                    blobs.append(_pack([number[s.v[at]], number[s.w[at]], n[at], s.cv[at], s.cw[at]], squeeze))
                yield pd.DataFrame({"bucket": s.bucket[starts].astype(np.int64), "chunk": r.chunk, "start": a, "blob": blobs})
            _release()


#: A row of the buckets' table. kind 0: the answer to a block. 1: of context v, its count
#: w, the same and one (n), the p(w) of its bigrams (x) and how many of them were seen 1
#: to 5 times (m1..m5). 2: how many bigrams (n) were seen v times.
FOUND = ("kind int, chunk long, start long, bucket long, blob binary, v long, w long, n long, x double, "
         "m1 long, m2 long, m3 long, m4 long, m5 long")


def _found(kind: int, size: int, **columns) -> pd.DataFrame:
    names = [c.split()[0] for c in FOUND.split(", ")]
    out = pd.DataFrame({c: columns.get(c, None if c == "blob" else 0) for c in names}, index=range(size))
    out["kind"], out["x"] = kind, out["x"].astype(float)
    return out


def _bucket(uni: Unigrams, heavy: int, pdf: pd.DataFrame) -> pd.DataFrame:
    blobs = pdf["blob"].tolist()
    sizes = [len(_unpack(b, 5)[0]) for b in blobs]
    ends = np.cumsum(sizes)
    table = np.empty((5, ends[-1]), dtype=np.int64)
    for blob, size, end in zip(blobs, sizes, ends):     # unpacked one by one
        table[:, end - size:end] = _unpack(blob, 5)
    v, w, n, cv, cw = table
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    at = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
    r = np.add.reduceat(n[order], at)
    heads = order[at]
    v, cv, cw = v[at], cv[heads], cw[heads]
    reply = np.empty(len(order), dtype=np.int64)
    reply[order] = np.repeat(r, np.diff(np.r_[at, len(order)]))
    del table, n, w, order, heads
    squeeze = zstandard.ZstdCompressor(level=3)
    out = [_found(0, len(blobs), chunk=pdf["chunk"].to_numpy(), start=pdf["start"].to_numpy(), bucket=pdf["bucket"].to_numpy(),
                  blob=[_pack([reply[end - size:end]], squeeze) for size, end in zip(sizes, ends)])]
    context = np.r_[True, v[1:] != v[:-1]]
    ctx = np.cumsum(context) - 1                        # a bigram's context
    v, cv = v[context], cv[context]
    m = [np.bincount(ctx[r == k], minlength=len(v)) for k in range(1, K + 1)]
    needed = cv >= heavy
    needed[ctx[r == 0]] = True
    seen = r > 0
    share = np.bincount(ctx[seen], uni.p(cw[seen]), len(v))
    some = np.flatnonzero(needed)
    out.append(_found(1, len(some), v=v[some], n=cv[some] + 1, x=share[some], w=cv[some],
                      **{f"m{k}": m[k - 1][some] for k in range(1, K + 1)}))
    counts = np.bincount(np.minimum(r, K + 2), minlength=K + 3)[:K + 2]
    out.append(_found(2, K + 1, v=np.arange(1, K + 2), n=counts[1:]))
    del v, cv, cw, r, reply, at, ctx, context, seen
    _release()
    return pd.concat(out, ignore_index=True)


#: A row of the logs table. kind 0: n tokens of a row, how many of them are known, their
#: base score and their logarithms (x) without the backoff weights. 1: n tokens of a row
#: back off from v.
LOGS = "kind int, row long, v long, n long, known long, base double, x double"


def _logs(uni: Unigrams, d2: list[float], buckets: int, heavy: int, total: int, types: int, chunk: pd.DataFrame,
          answers: pd.DataFrame) -> pd.DataFrame:
    """The answers to a chunk's blocks, laid out over its tokens."""
    out = []
    log_d = np.log10(np.array([1.0, *d2, 1.0]))
    answers = answers.sort_values(["start", "bucket"])
    of_start = dict(list(answers.groupby("start")["blob"]))
    for c in chunk.itertuples(index=False):
        number, count = np.asarray(c.numbers, dtype=np.int64), np.asarray(c.counts, dtype=np.int64)
        for a, rows, s in _slices(buckets, heavy, c):
            r = np.zeros(len(s.v), dtype=np.int64)
            if len(s.order):
                r[s.order] = np.concatenate([_unpack(b, 1)[0] for b in of_start[a]])
            p = np.where(r > 0, np.log10(np.maximum(r, 1)) - np.log10(s.cv + 1) + log_d[np.minimum(r, K + 1)],
                         np.log10(uni.p(s.cw)))
            of_word = count[s.tokens]
            base = np.log10((of_word + 1) / (total + types + 1))
            out.append(pd.DataFrame({
                "kind": 0, "row": c.chunk + a + np.arange(rows), "v": 0, "n": np.bincount(s.row, minlength=rows),
                "known": np.bincount(s.row[of_word > 0], minlength=rows), "base": np.bincount(s.row, base, rows),
                "x": np.bincount(s.row, p[s.of], rows)}))
            backs = ((r == 0) & (s.cv > 0))[s.of]
            key, n = np.unique(s.row[backs].astype(np.int64) * len(number) + s.v[s.of[backs]], return_counts=True)
            row, v = np.divmod(key, len(number))
            out.append(pd.DataFrame({"kind": 1, "row": c.chunk + a + row, "v": number[v], "n": n, "known": 0, "base": 0.0, "x": 0.0}))
        _release()
    return pd.concat(out, ignore_index=True)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2,
          chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each
    row of ``docs``; ``score`` is the model's log10 probability of the whole text.

    The model learns from the rows outside the held-out fold (rows with a null id are
    learned from). Words are in lower case (A-Z), between ASCII white space; each
    text ends in one end token, which is also the context of its first word. Null and
    empty texts are one end token. Repeated rows count as often as they occur. Without
    training rows every token is the unknown word (probability 1).
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), is_fold(id_col, folds, held_out).alias("held"))
    kind = keyed.schema["id"].dataType.simpleString()
    chunks, chunks_path = write_table(keyed.mapInPandas(
        lambda b: _chunks(chunk_tokens, b), f"chunk long, ids array<{kind}>, held array<boolean>, lengths array<int>, "
        "tokens binary, words array<string>, train array<long>"), "katz-chunks")
    # a word's rows are one per chunk; its number is that of one of them. Within a
    # chunk the ids rise in the order of its words
    words = (chunks.select("chunk", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("train").alias("train"))))
             .withColumn("id", F.monotonically_increasing_id()))
    of_word = Window.partitionBy("word")
    counted = words.select("chunk", "id", F.sum("train").over(of_word).alias("c"), F.min("id").over(of_word).alias("number"))
    # back to the chunks: the words of a chunk are no more than its tokens
    unigrams, unigrams_path = write_table(counted.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("id", "number", "c"))).alias("z"))
        .select("chunk", F.col("z.number").alias("numbers"), F.col("z.c").alias("counts"),
                F.transform("z", lambda x: F.when(x["id"] == x["number"], x["c"])).alias("own")), "katz-unigrams")
    free_shuffles(docs.sparkSession)
    known = unigrams.select(F.explode("own").alias("c")).where("c > 0")
    total, types = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    uni = Unigrams({r["c"]: r["n"] for r in known.where(F.col("c") <= K + 1).groupBy("c").agg(
        F.count(F.lit(1)).alias("n")).collect()}, int(total))
    tokens = chunks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets, heavy = max(1, ceil(tokens / bucket_tokens)), max(1, bucket_tokens // LIGHT)
    own = unigrams.select(F.col("chunk").alias("c"), "numbers", "counts")
    numbered, _ = write_table(chunks.drop("words", "train").join(own, F.col("chunk") == F.col("c")).drop("c"), "katz-numbered")
    for path in (chunks_path, unigrams_path):
        drop_table(docs.sparkSession, path)
    free_shuffles(docs.sparkSession)
    cut = numbered.select("chunk", "held", "lengths", "tokens", "numbers", "counts")
    blocks = cut.mapInPandas(lambda b: _blocks(buckets, heavy, b), "bucket long, chunk long, start long, blob binary")
    found, _ = write_table(blocks.groupBy("bucket").applyInPandas(lambda pdf: _bucket(uni, heavy, pdf), FOUND), "katz-buckets",
                           by="kind")
    free_shuffles(docs.sparkSession)

    d2 = discounts({x["v"]: x["n"] for x in found.where("kind = 2").groupBy("v").agg(F.sum("n").alias("n")).collect()})
    answers = found.where("kind = 0").select("chunk", "start", "bucket", "blob")
    size = (int(total), int(types))
    logs, _ = write_table(cut.drop("held").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        lambda chunk, of: _logs(uni, d2, buckets, heavy, *size, chunk, of), LOGS), "katz-logs", by="kind")
    free_shuffles(docs.sparkSession)

    # a heavy context is in several buckets
    contexts = found.where("kind = 1").groupBy("v").agg(
        F.max("n").alias("n"), F.max("w").alias("c"), F.sum("x").alias("x"), *[F.sum(f"m{k}").alias(f"m{k}") for k in range(1, K + 1)])
    freed = sum((F.col(f"m{k}") * (k * (1 - d)) for k, d in enumerate(d2, 1)), F.lit(0.0))
    weights = contexts.select(F.col("v").alias("context"), F.log10(
        (F.col("n") - F.col("c") + freed) / F.col("n") / (1 - F.col("x"))).alias("weight"))
    backs = (logs.where("kind = 1").select("v", F.col("row").alias("r"), "n").join(weights, F.col("v") == F.col("context"))
             .groupBy("r").agg(F.sum(F.col("n") * F.col("weight")).alias("off")))
    rows = numbered.select("chunk", "held", F.posexplode("ids").alias("at", id_col)).select(
        (F.col("chunk") + F.col("at")).alias("r"), id_col, F.element_at("held", F.col("at") + 1).alias("held_out"))
    scored = logs.where("kind = 0").select(F.col("row").alias("r"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
                                           F.col("base").alias("base_score"), F.col("x").alias("score"))
    return (rows.join(scored, "r").join(backs, "r", "left")
            .select(id_col, "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
                    "base_score", (F.col("score") + F.coalesce("off", F.lit(0.0))).alias("score")))
