"""Source mixing, centroid clustering and token alignment against brute force."""

from __future__ import annotations

import functools
import hashlib
import math
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tokenizers
import xxhash
from pyspark.sql import functions as F

from cirrus.llm import alignment, centroids, mixing

WORD = regex.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- source mixing -----------------------------------------------------------------------

def spark_hash(*parts) -> int:
    """xxhash64 of Spark over longs and texts; null leaves the hash as it is."""
    seed = 42
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<q", p), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def permuted(index, n, seed, source, epoch):
    for r in range(1, mixing.ROUNDS + 1):
        other = (spark_hash(seed, source, epoch, r, 0) % n - index) % n
        if spark_hash(seed, source, epoch, r, 1, max(index, other)) & 1:
            index = other
    return index


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight, stop at the caps, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        above = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not above:
            return names, target
        full |= above


def brute_mix(rows, block_words, seed=11):
    sizes = defaultdict(int)
    docs = [(d, s, len(WORD.findall(t or "")), spark_hash(d, t)) for d, t, s in rows]
    for _, s, n, _ in docs:
        sizes[s] += n
    names, target = targets(sizes)
    out = []
    for number, s in enumerate(names):
        mine = sorted(((h % mixing.PARTS, h, d, n) for d, x, n, h in docs if x == s), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3]))
        blocks = math.ceil(sizes[s] / block_words)
        quota = math.floor(target[s] / sizes[s] * blocks + 0.5) if sizes[s] else 0
        times = Counter(permuted(r % blocks, blocks, seed, number, r // blocks) for r in range(quota))
        place = 0
        for _, _, d, n in mine:
            out.append((d, n, sizes[s], round(target[s], 6), sum(times[w // block_words] for w in range(place, place + n))))
            place += n
    return sorted(out, key=str)


def mix_rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        source = ["hot", "web", "books", None, "über", "z"][min(int(rng.exponential(1.2)), 5)]
        rows.append((i, " ".join(f"w{j}" for j in range(int(rng.integers(0, 90)))), source))
    rows += [(7, "a\tb\x0bc  d", "tiny"), (None, "x y z", "web"), (301, None, "web"), (302, "", "void"), (302, "", "void"),
             (303, " ".join(["long"] * 4000), "books"), (7, "a\tb\x0bc  d", "tiny")]
    return rows


@pytest.fixture(scope="module")
def mixed(spark):
    frame = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in mix_rows()], DOCS).withColumn("size", F.lit("clash"))
    return mixing.mix(frame, block_words=16, shard_slots=50)


def test_mix_equals_brute_force(mixed):
    got = sorted(((r["id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.taken(mixed).collect()), key=str)
    assert got == brute_mix(mix_rows(), 16)
    assert all(taken <= 3 * size for _, size, _, _, taken in got)


def test_mix_slots(mixed):
    slots = mixed.slots.collect()
    quota = {r["source_no"]: (r["quota"], r["blocks"]) for r in mixed.sources.collect()}
    total = sum(q for q, _ in quota.values())
    assert len(slots) == total
    by_shard = Counter(r["shard"] for r in slots)
    assert all(by_shard[s] == min(50, total - 50 * s) for s in range(math.ceil(total / 50)))
    assert len({(r["shard"], r["slot"]) for r in slots}) == total
    assert Counter(r["source_no"] for r in slots) == {s: q for s, (q, _) in quota.items() if q}
    assert len({(r["source_no"], r["epoch"], r["block"]) for r in slots}) == total      # a block once a round
    assert all(0 <= r["block"] < quota[r["source_no"]][1] for r in slots)


def test_mix_draws_are_multinomial(spark, mixed):
    sources = mixed.sources.orderBy("source_no").collect()
    total = sum(r["quota"] for r in sources)
    owner = [r["source_no"] for r in sources for _ in range(r["quota"])]
    want = Counter((owner[spark_hash(11, i) % total], i // 50) for i in range(total))
    got = {(r["source_no"], r["shard"]): r["drawn"] for r in mixing._draw(mixed.sources, total, 50, 11).collect()}
    assert got == want


def test_mix_spans_make_up_blocks(mixed):
    spans = mixing.spans(mixed)
    size = {r["source_no"]: r["source_size"] for r in mixed.sources.collect()}
    for r in spans.groupBy("shard", "slot", "source_no", "block").agg(F.sum("words").alias("n")).collect():
        assert r["n"] == min(16, size[r["source_no"]] - 16 * r["block"])


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.taken(mixing.mix(empty)).collect() == []
    blank = spark.createDataFrame([(1, None, None, "a", 0), (2, " ", None, None, 0)], DOCS)
    assert sorted(tuple(r) for r in mixing.taken(mixing.mix(blank)).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        frame = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n), 3, F.lit(0), F.lit(1)).alias("x"))
        assert sorted(r["x"] for r in frame.collect()) == list(range(n))


# --- centroid clustering -----------------------------------------------------------------

def brute_clusters(points: list[tuple[int, np.ndarray]], k, rounds, seed=3):
    x = np.array([p for _, p in points])
    first = sorted(range(len(points)), key=lambda i: (hashlib.sha256(f"{seed}:{points[i][0]}".encode()).hexdigest(), x[i].astype("<i4").tobytes()))
    centres = x[first[:k]].copy()
    for r in range(rounds + 1):
        d = ((x[:, None] - centres) ** 2).sum(-1)
        near = d.argmin(1)
        if r == rounds:
            return near, d.min(1), centres
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].sum(0) // (near == c).sum()


def vectors(n, dims, spread, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dims))
    return [(int(i), (middle[rng.integers(6)] + spread * rng.normal(size=dims)).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize("n,dims,k,spread,scale", [(400, 8, 8, 0.3, 1024), (300, 4, 20, 1.0, 8), (200, 2, 5, 1.0, 2), (60, 3, 1, 1.0, 16)])
def test_clusters_equal_brute_force(spark, monkeypatch, n, dims, k, spread, scale):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 64)
    rows = vectors(n, dims, spread, n) + [(3, [0.5] * dims)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    got, centres = centroids.cluster(frame, dims=dims, k=k, rounds=6, scale=scale)
    points = [(i, np.floor(scale * np.array(v)).astype(np.int64)) for i, v in rows]
    near, d, want = brute_clusters(points, k, 6)
    assert np.array_equal(centres, want)
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, int(a), int(b)) for (i, _), a, b in zip(points, near, d))


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    middle = rng.integers(-4000, 4000, size=(8, 64))
    points = middle[rng.integers(8, size=2000)] + rng.integers(-400, 400, size=(2000, 64))
    state, first = centroids.assign(points, centroids.Centres(middle, None), None)
    again, later = centroids.assign(points, centroids.Centres(middle + 1, middle), state)
    assert first < 8 * 2000 and later == 0 and np.array_equal(again["near"], state["near"])


def test_cluster_odd_rows(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [0.0, 1.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, []),
            (8, [0.0, 1.0]), (8, [0.0, 1.0]), (None, [-0.5, 0.25])]
    got = centroids.with_inertia(*centroids.cluster(spark.createDataFrame(rows, schema), dims=2, k=8)).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "8", "8", "None"]
    assert {r["cluster"] for r in got if r["vec_id"] is not None} == {0} or len({r["distance"] for r in got}) <= 2
    assert len({r["inertia"] for r in got}) == 1
    empty, centres = centroids.cluster(spark.createDataFrame([], schema), dims=2)
    assert empty.count() == 0 and len(centres) == 0
    assert centroids.with_inertia(empty, centres).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="would not fit"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0])], schema), dims=2)


# --- token alignment ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def aligner():
    files = [open(public_tokenizers.path(f), "rb").read() for f in (alignment.A_FILE, alignment.B_FILE)]
    return alignment.Aligner(*files)


@functools.cache
def libraries():
    """Both tokenizers, applied to whole texts."""
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path(alignment.A_FILE))
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_FILE))


def brute_groups(aligner, text):
    """Groups of a text, cut where both sides end."""
    if not text:
        return []
    tokenizer, model = libraries()
    a = tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    whole = b" " + text.encode()
    a_bytes, b_bytes = aligner.a_bytes, aligner.b_bytes
    if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
        return []
    found, i, j, at_a, at_b, mine = [], 0, 0, 0, 0, ([], [])
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            at_a += len(a_bytes[a[i]])
            mine[0].append(a[i])
            i += 1
        else:
            at_b += len(b_bytes[b[j]])
            mine[1].append(b[j])
            j += 1
        if at_a == at_b:
            found.append(mine)
            mine = ([], [])
    return found


def brute_align(aligner, rows):
    per = [(d, brute_groups(aligner, t)) for d, t in rows]
    held = Counter()
    for _, found in per:
        held.update({(x, y) for a, b in found for x in a for y in b})
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for d, found in per:
        links = [(x, y) for a, b in found for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        out.append((d, sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(links),
                    sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return sorted(out, key=str)


TEXTS = ["Hello world", "", None, "internationalisation of naïve façades", "  two  spaces ", "日本語のテキスト、 ไทย and emoji 🙂🙂", "tab\tand\nline\r\n",
         "<|endoftext|> and <s> are </s> text", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "12345 67.89 0x1F", "▁ a low bar", "Hello world",
         "a b c", "ﬁne ①②", "x" * 5000, "\u0000\u0001", " leading", "don't we'll I'm", "égalité", "١٢٣ مرحبا", "﻿bom"]


def test_align_equals_brute_force(spark, aligner, sf_small):
    rows = list(enumerate(TEXTS)) + [(None, "Hello world"), (3, "Hello world")]
    rows += [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").limit(120).collect()]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, pairs string, block int").repartition(3)
    got = alignment.align(frame).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_align(aligner, rows)


def test_align_in_small_steps(spark, aligner, monkeypatch):
    """Long texts in parts, many blocks, wide groups by distinct ids."""
    monkeypatch.setattr(alignment, "STEP_BYTES", 64)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 200)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 3)
    rows = [(i, (t or "") * 3 + " so a longer text goes on and on, it does not end early: " + (t or "")) for i, t in enumerate(TEXTS) if t != "x" * 5000]
    rng = np.random.default_rng(2)
    rows += [(100 + i, "".join(rng.choice(list("ab c,dé日🙂1\n"), size=300))) for i in range(20)]
    assert any(len(aligner.parts(t)) > 1 for _, t in rows) and aligner.cuts
    held = {k: [] for k in ["ids", *alignment._DOC, "groups_sha256", "pairs", "many"]}
    for i, t in rows:
        for name, values in {"ids": [i], **aligner.align([t])}.items():
            held[name] += values
    assert [(i, *found) for i, found in zip(held["ids"], zip(held["n_a"], held["n_b"], held["n_groups"], held["n_links"], held["groups_sha256"]))] == [
        (d, na, nb, ng, nl, sha) for d, na, nb, ng, nl, _, _, sha in sorted(brute_align(aligner, rows))]
    for (i, t), pairs, many in zip(rows, held["pairs"], held["many"]):
        want = Counter(x * aligner.n_b + y for a, b in brute_groups(aligner, t) for x in a for y in b)
        assert dict(zip(pairs.tolist(), many.tolist())) == want


def test_ids_are_those_of_the_libraries(aligner, sf_small, spark):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()] + TEXTS
    texts += ["a \n b", "a\n  b", "x  \t y ", "   ", "\n\n", "a'sb's 'Re", "\u3000全角\u3000", "a\u00a0b", "e\u0301a", "\u2028x"]
    tokenizer, model = libraries()
    texts += [f"a{chr(c)}1 {chr(c)}{chr(c)}.{chr(c)} z" for c in range(1, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    for text in texts:
        a, b = aligner.tokens(text)
        if len(a):
            assert a.tolist() == tokenizer.encode(" " + text, add_special_tokens=False).ids and b.tolist() == model.encode(text)
        else:
            assert brute_groups(aligner, text) == []


def test_groups_of_random_cuts():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        ends = [np.append(np.sort(rng.choice(np.arange(1, n), size=int(rng.integers(0, n)), replace=False)), n) for _ in range(2)]
        common = np.intersect1d(*ends)
        for side, found in zip(ends, alignment.groups(*ends)):
            assert np.array_equal(found, common[np.searchsorted(common, side)])


def test_align_of_nothing(spark):
    empty = alignment.align(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and "count_sum" in empty.columns
    blank = alignment.align(spark.createDataFrame([(1, None), (1, ""), (None, "")], "doc_id long, text string"))
    assert sorted((tuple(r) for r in blank.collect()), key=str) == sorted([(1, *[0] * 6, ""), (1, *[0] * 6, ""), (None, *[0] * 6, "")], key=str)
