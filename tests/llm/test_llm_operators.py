"""The training-data operators against brute-force versions on small tables."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
import xxhash
import zstandard
from pyspark.sql import functions as F

from cirrus.llm import (bpe, components, decontaminate, embedding_dedup, katz, langid, line_dedup, quality, queries,
                        simhash, toxicity, url_filter)
from cirrus.llm.storage import write_table
from cirrus.sources.tables import load


def union_find(nodes, pairs):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def docs_of(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def crc(i):
    import zlib
    return zlib.crc32(str(i).encode())


# components

def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(0, k) for k in range(150, 190)] \
        + [(k, k + 1) for k in range(300, 330)] + [(-5, -(1 << 63))]
    df = spark.createDataFrame(pairs + [(None, 3), (4, 4)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == union_find(linked, [p for p in pairs if p[0] != p[1]])
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1

def test_quality_finds_junk_in_held_out_rows(spark, sf_small):
    sf = sf_small.replace("sf0.001", "sf0.01")
    got = (queries.op1_quality_classifier(spark, sf).join(load(spark, sf, "labels"), "doc_id").where("held_out")
           .selectExpr("avg(int(predicted = quality)) a", "min(score) lo", "max(score) hi").first())
    assert got["a"] >= 0.95 and 0 <= got["lo"] and got["hi"] <= 1


def test_rule_model_is_what_it_compiles_to(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.3) & (x[:, 4] < 0.5)).astype(float)
    model = quality.fit_rules(x, y)
    assert model.rules
    total = np.full(len(x), model.intercept)
    for rule, w in model.rules:
        total += w * quality._holds(rule, x)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i long, s array<double>")
    got = [r["p"] for r in df.select("i", model.score(F.col("s")).alias("p")).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    assert (((np.array(got) >= 0.5) == y).mean()) > 0.95
    assert len(model.rules) < 400


def test_quality_without_labels(spark):
    docs = docs_of(spark, ["a b", None, ""])
    model = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality.score(docs, model).collect()] == [0.5] * 3


# 2

def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
             .replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_on_documents(spark, sf_small, monkeypatch):
    docs = load(spark, sf_small, "documents")
    extra = docs.limit(0).union(spark.createDataFrame(
        [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, " \n", None, None, None), (9004, "One two", "en", "s", 1),
         (9005, "ONE two", "en", "s", 1)], docs.schema))
    docs = docs.union(extra)
    rows = docs.select("doc_id", "text").collect()
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = union_find(ids, pairs)
    for block in (2048, 2):
        got = simhash.near_duplicates(docs, block=block).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert all(r["fingerprint"] == f"{prints[r['doc_id']]:016x}" for r in got)


def test_simhash_links_dense_groups(spark):
    """Clusters around a few centres, in blocks so small that all levels and tiles are used."""
    rng = random.Random(5)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(120):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    full = (1 << 64) - 1
    want = union_find(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if ((a ^ b) & full).bit_count() <= 3])
    for block in (2048, 16):
        links = [(r["a"], r["b"]) for r in simhash.links(df, block).collect()]
        assert all(((a ^ b) & full).bit_count() <= 3 for a, b in links)
        assert union_find(fps, links) == want


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


# 3

def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.normal(size=24)
        for _ in range(25):
            rows.append((len(rows), (centre + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.12, 0.3])).tolist(), c % 3))
    rows += [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] + [1.0] * 23, 1), (1003, [None] + [1.0] * 23, 1),
             (1004, rows[0][1], None), (1005, [2 * x for x in rows[0][1]], rows[0][2]), (1006, [1.0, 2.0], 1), (1006, [1.0, 2.0], 1),
             (1007, [], 1), (1008, [float("inf")] + [1.0] * 23, 1), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(i, v, lab, 7) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, n long")
    ok = [(i, v, lab) for i, v, lab in rows if i is not None and lab is not None and v
          and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, n = [], Counter()
    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            x, y = np.array(ok[a][1], float), np.array(ok[b][1], float)
            if ok[a][2] == ok[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((ok[a][0], ok[b][0]))
                n[a] += 1
                n[b] += 1
    want = union_find([i for i, _, _ in rows if i is not None], links)
    by_id = {ok[a][0]: k for a, k in n.items()}
    assert len(links) > 500
    for tile in (512, 8):
        got = embedding_dedup.near_duplicates(df, tile=tile).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["vec_id"] is None:
                assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
            else:
                assert r["component_id"] == want[r["vec_id"]] and r["kept"] == (want[r["vec_id"]] == r["vec_id"])
                assert r["n_links"] == by_id.get(r["vec_id"], 0)


@pytest.mark.parametrize("bits,bands", [(14, 4), (20, 26)])
def test_code_estimate_is_unbiased_and_bounded(bits, bands):
    rng = np.random.default_rng(4)
    x = embedding_dedup.units(rng.normal(size=(300, 64)))
    y = embedding_dedup.units(x + rng.normal(size=x.shape) * rng.choice([0.02, 0.1, 1.0], size=(300, 1)))
    a, b = embedding_dedup.encode(x, bits, bands), embedding_dedup.encode(y, bits, bands)
    estimate, error = embedding_dedup.one_way(embedding_dedup.prepare(*a), embedding_dedup.prepare(*b))
    off = estimate - x @ y.T
    assert abs(off.mean()) < 0.005 and abs(np.diag(off).mean()) < 0.03
    assert (np.abs(off) <= embedding_dedup.CONFIDENCE * error).mean() > 0.999
    assert np.sqrt((off ** 2).mean()) < 1.1 * np.sqrt((error ** 2).mean())


def test_bits_grow_with_rows_and_bands_hold_the_recall():
    small, large = embedding_dedup.shape(1_000), embedding_dedup.shape(1_000_000_000)
    assert large[0] - small[0] == 20 and large[1] > small[1]
    rng = np.random.default_rng(5)
    x = embedding_dedup.units(rng.normal(size=(4000, 64)))
    z = rng.normal(size=x.shape)
    z = embedding_dedup.units(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * z                       # pairs at the threshold itself
    for rows in (1_000, 10_000_000):
        bits, bands = embedding_dedup.shape(rows)
        a, b = (embedding_dedup.band_values(embedding_dedup.encode(v, bits, bands)[0], bits, bands) for v in (x, y))
        assert (a == b).any(1).mean() > 0.995


def test_embeddings_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(df).collect() == []


# 4

URLS = ["http://Example.COM/en/a", "http://www.example.com/en/a?x=/en/", "https://a.b.example.com/en/", "http://example.com/en",
        "http://x.net/es/1", "http://net/fr/", "http://y.org/", "nothing", None, "", "http://", "http://example.com", "x://com/#a",
        "http://notexample.com/en/", "http://example.com./en/", "http://example.com:80/en/", "a://b://com/", "http://x.net/es/fr/\n/"]


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_url_filter(spark):
    rules = queries.URL_RULES + [("example.com", "/en/ab", "block"), ("org", "", "block")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, rule string")
    got = url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert tuple(r)[1:] == brute_verdict((URLS + URLS[:2])[r["page_id"]], rules)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_filter.filter_urls(pages, none).collect()} == {"allow"}


def test_url_filter_of_long_urls_empty_tables_and_ties(spark):
    schema = "host string, path string, verdict string"
    rules = spark.createDataFrame([("example.com", "/a/b/", "block"), ("x.example.com", "/a/", "allow"), ("t.org", "/p", "allow"), ("t.org", "/p", "block"),
                                   ("T.org", "/p", "allow"), ("org", "/p/q", "allow")], schema)
    deep = "http://x.example.com/a/" + "b/" * 400_000
    wide = "http://" + "x." * 100_000 + "example.com/a/b/c"
    pages = spark.createDataFrame([(1, deep), (2, wide), (3, "http://t.org/pq"), (4, "http://t.org/p/q"), (5, None), (6, "x"), (1, "http://t.org/pq")],
                                  "page_id long, url string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect() if r["page_id"] < 5)
    assert got == [(1, "t.org/p", "block"), (1, "x.example.com/a/", "allow"), (2, "x.example.com/a/", "allow"), (3, "t.org/p", "block"),
                   (4, "t.org/p", "block")]
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_filter_sql(spark, sf_small):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_small}/pages.parquet')")
    want = sorted(con.execute(queries.ORACLE_SQL["op4_url_filter"]).fetchall(), key=str)
    assert sorted(map(tuple, queries.op4_url_filter(spark, sf_small).collect()), key=str) == want


# 5

def test_line_dedup(spark):
    passage = ["the quick brown fox jumps over it", "and a second line of the passage", "", "and a third one to end it all"]
    texts = ["\n".join(["own start of zero"] + passage + ["own end of zero"]),
             "\n".join(["own start of one", *passage, "own end of one"]),
             "nothing shared here\nat all in two lines",
             "\n".join(["x"] + passage[:2] + ["a line between the two of them", passage[3], "y"]),
             "\n".join(["own start of zero"] + passage + ["own end of zero"]), None, "", "own end of zero", "own end of zero"]
    got = {r["doc_id"]: r for r in line_dedup.remove_shared(docs_of(spark, texts)).collect()}
    assert got[0]["text"] == texts[0] and got[2]["text"] == texts[2]
    assert got[1]["text"] == "own start of one\nown end of one" and got[1]["lines_removed"] == 3
    assert got[3]["text"] == "\n".join(["x", "a line between the two of them", passage[3], "y"]).replace(passage[3], passage[3]) \
        or got[3]["text"] == "x\na line between the two of them\ny"
    assert got[4]["text"] == "" and got[5]["text"] is None and got[6]["text"] == ""
    assert got[7]["text"] == texts[7]       # four words: too short for a block


def test_line_dedup_keeps_the_first_of_every_long_line(spark, sf_small):
    docs = load(spark, sf_small, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r for r in line_dedup.remove_shared(docs).collect()}
    assert set(after) == set(before)
    holders = defaultdict(set)
    for i, t in before.items():
        for line in t.split("\n"):
            holders[line.strip()].add(i)
    for i, t in before.items():
        gone = Counter(t.split("\n")) - Counter(after[i]["text"].split("\n"))
        # what went is held by an earlier document; what is first here stays
        assert all(min(holders[x.strip()]) < i for x in gone if x.strip())
    left = Counter()
    for i, r in after.items():
        left.update({x.strip() for x in r["text"].split("\n") if len(x.split()) >= 8})
    alone = [x for x, n in left.items() if n > 1]
    # a line of its own words is removed wherever an earlier document has it as often
    assert len(alone) <= 0.01 * len(left)


def brute_line_dedup(texts, min_words):
    """Texts without the lines of any run of ``min_words`` words that an earlier text holds."""
    split = [[(at, x.strip(), len(x.split())) for at, x in enumerate(t.split("\n")) if x.strip()] for t in texts]

    def runs(lines):
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(x[2] for x in lines[i:j + 1]) >= min_words:
                    yield i, j, tuple(x[1] for x in lines[i:j + 1])

    out, earlier = [], set()
    for t, lines in zip(texts, split):
        gone = {at for i, j, k in runs(lines) if k in earlier for at in range(lines[i][0], lines[j][0] + 1)}
        earlier |= {k for _, _, k in runs(lines)}
        out.append("\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone))
    return out


def test_line_dedup_moved_and_repeated_passages(spark):
    p = ["one passage of five words", "and its second line here"]
    q = ["another passage has these words", "and this is its end"]
    x = "a line of its own with nine words altogether"
    texts = ["\n".join(p + q), "\n".join(["own"] + q + p), x, "\n".join([x, "between", x]),
             "\n".join(p + ["own"] + p + ["more"] + q + p)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_shared(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(5)] == [texts[0], "own", x, "between", "own\nmore"]
    # against all runs, two documents at a time
    rng = random.Random(4)
    for _ in range(400):
        a, b = (rng.choices("abcdef", k=rng.randrange(12)) for _ in range(2))
        size = dict(zip("abcdef", (1, 1, 2, 3, 5, 8)))
        lines = [[(n, c, size[c]) for n, c in enumerate(t)] for t in (a, b)]
        first, later = (line_dedup.runs_of([(n, c.encode(), w, n) for n, c, w in x], 6) for x in lines)
        mine = sorted((n, k, i, j) for k, places in later.items() if k in first for n, i, j in places)
        other = sorted((n, k) for k, places in first.items() if k in later for n, _, _ in places)
        gone = {k for blocks in line_dedup.alignments(mine, other) for i, j in blocks for k in range(i, j + 1)}
        text = ["\n".join(" ".join([c] * size[c]) for c in t) for t in (a, b)]
        left = brute_line_dedup(text, 6)[1]
        assert left == "\n".join(" ".join([c] * size[c]) for k, c in enumerate(b) if k not in gone)


def test_line_dedup_passages_of_short_lines(spark):
    rows = ["milk", "two eggs", "flour", "salt", "butter", "brown sugar", "yeast"]
    texts = ["first line here\nalone", "and the second line\nalso alone", "\n".join(["x", "first line here", "and the second line", "y y"]),
             "\n".join(["z", "first line here", "and the second line", "last of all"]),
             "\n".join(["own list", *rows]), "\n".join(rows + ["end"]), "\n".join(rows[:4] + ["own", "own"] + rows[4:])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_shared(docs_of(spark, texts), min_words=7).collect()}
    assert [got[i] for i in range(7)] == texts[:3] + ["z\nlast of all", texts[4], "end", texts[6]]
    rng = random.Random(9)
    known = ["a", "b b", "c c c", "d d", "e", "f f f f f", "g g g g g g g g g", "h"]
    texts = ["\n".join(rng.choice(known) if rng.random() < 0.8 else rng.choice(["", f"own {k}"])
                       for _ in range(rng.randrange(1, 14))) for k in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_shared(docs_of(spark, texts)).collect()}
    want = brute_line_dedup(texts, 8)
    shown = lambda t: [x for x in t.split("\n") if x]
    assert [shown(got[k]) for k in range(60)] == [shown(t) for t in want]


def test_line_dedup_is_decided_by_its_alignments(spark, monkeypatch):
    line = lambda k: f"line {k} has eight words in it here"
    n = 3000
    for order in (list(range(n))[::-1], random.Random(2).sample(range(n), n), [0] * n):
        mine = [(i, line(k).encode(), i, i) for i, k in enumerate(order)]
        passes = list(line_dedup.alignments(mine, [(k, line(k).encode()) for k in range(n)]))
        assert {i for blocks in passes for a, b in blocks for i in range(a, b + 1)} == set(range(n))
        assert len(passes) <= 2 * n ** 0.5
    monkeypatch.setattr(line_dedup, "align", lambda *_: [])
    assert not list(line_dedup.alignments([(0, b"x", 0, 0)], [(0, b"x")]))


def test_line_dedup_page_that_quotes_many(spark):
    line = lambda k: f"line {k} has eight words in it here"
    texts = [f"own {k}\n{line(k)}" for k in range(300)] + ["\n".join(["own", *(line(k) for k in reversed(range(300))), "end"])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_shared(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(301)] == [*texts[:300], "own\nend"]


def test_align_grows_blocks():
    lines = lambda s: [(i, c) for i, c in enumerate(s)]
    assert line_dedup.align(lines("abcxdef"), lines("zabcydef")) == [(0, 1, 3), (4, 5, 3)]
    assert line_dedup.align(lines("aab"), lines("aab")) == [(0, 0, 3)]
    assert line_dedup.align(lines("ab"), lines("ba")) in ([(0, 1, 1)], [(1, 0, 1)])
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcde") for _ in range(rng.randrange(12))) for _ in range(2))
        blocks = line_dedup.align(lines(a), lines(b))
        assert all(a[i:i + n] == b[j:j + n] for i, j, n in blocks)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(blocks, blocks[1:]))
        assert bool(blocks) == bool(set(a) & set(b))


# 6

def brute_katz(texts):
    tokens = {i: [*((t or "").encode().lower().split()), b""] for i, t in texts.items()}
    train = [i for i in texts if crc(i) % 7 != 2]
    uni, big = Counter(), Counter()
    for i in train:
        uni.update(tokens[i])
        big.update(zip([b"", *tokens[i]], tokens[i]))
    total, types = sum(uni.values()), len(uni)
    d1, d2 = (katz.discounts(Counter(c.values())) for c in (uni, big))
    cut = lambda d, r: d[r - 1] if r <= 5 else 1.0
    freed = sum(r * (1 - cut(d1, r)) for r in uni.values())
    n1 = total + (freed <= 0)
    left = (freed if freed > 0 else 1) / n1
    p1 = lambda w: cut(d1, uni[w]) * uni[w] / n1 if w in uni else left
    after = defaultdict(dict)
    for (v, w), r in big.items():
        after[v][w] = r

    def p(v, w):
        if v not in after:
            return p1(w)
        f = after[v]
        n = uni[v] + 1
        if w in f:
            return cut(d2, f[w]) * f[w] / n
        return (1 - sum(cut(d2, r) * r for r in f.values()) / n) / (1 - sum(p1(x) for x in f)) * p1(w)

    out = {}
    for i, ts in tokens.items():
        out[i] = (crc(i) % 7 == 2, len(ts), sum(uni[t] > 0 for t in ts), total,
                  sum(math.log10((uni[t] + 1) / (total + types + 1)) for t in ts),
                  sum(math.log10(p(v, w)) for v, w in zip([b"", *ts], ts)))
    for v in list(after)[:40]:
        assert math.isclose(sum(p(v, w) for w in uni) + p(v, "never seen"), 1, rel_tol=1e-9)
    return out


@pytest.mark.parametrize("chunk, bucket", [(1 << 22, 1 << 22), (900, 250), (5000, 60)])
def test_katz(spark, sf_small, chunk, bucket):
    docs = load(spark, sf_small, "documents").where("doc_id < 90")
    docs = docs.union(spark.createDataFrame([(5001, None, None, None, None), (5002, "", "en", "s", 0), (5003, "Zzz of the", "", "", 1)], docs.schema))
    want = brute_katz({r["doc_id"]: r["text"] for r in docs.collect()})
    got = katz.score(docs.repartition(3), chunk_tokens=chunk, bucket_tokens=bucket).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["doc_id"]]
        assert tuple(r)[1:5] == w[:4]
        assert math.isclose(r["base_score"], w[4], rel_tol=1e-9) and math.isclose(r["score"], w[5], rel_tol=1e-9)


def test_katz_without_training_rows(spark):
    held = next(i for i in range(100) if crc(i) % 7 == 2)
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = katz.score(df).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0)
    assert katz.score(df.limit(0)).count() == 0


def test_katz_writes_no_row_for_each_document_and_bucket(spark, monkeypatch):
    """What goes back to the documents must not grow with the number of buckets."""
    text = " ".join(f"w{i * i % 101}" for i in range(300))
    docs = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string").repartition(2)
    written = []

    def write(df, name, by=None):
        out = write_table(df, name, by)
        written.append((name, out[0].count()))
        return out

    monkeypatch.setattr(katz, "write_table", write)
    wide, narrow = (katz.score(docs, bucket_tokens=b).orderBy("doc_id").collect() for b in (1 << 20, 1000))
    assert max(n for _, n in written) < 300 * 4 and len(narrow) == 300
    for a, b in zip(wide, narrow, strict=True):
        assert a[:5] == b[:5] and math.isclose(a["score"], b["score"], rel_tol=1e-9)


def test_katz_bucket_memory():
    """A bucket's worker holds some columns of its bigrams, not rows of documents."""
    rng, size = np.random.default_rng(6), 300_000
    tokens = rng.integers(1, 3000, size).astype("<i4")
    count = np.bincount(tokens, minlength=3000)
    chunk = pd.DataFrame({"chunk": [0], "held": [np.zeros(size // 100, dtype=bool)], "lengths": [np.full(size // 100, 100)],
                          "tokens": [zstandard.compress(tokens.tobytes())], "numbers": [np.arange(3000) << 20], "counts": [count]})
    blocks = pd.concat(katz._blocks(1, 1 << 40, iter([chunk])))
    uni = katz.Unigrams({}, size)
    katz._bucket(uni, 1 << 40, blocks)
    tracemalloc.start()
    try:
        found = katz._bucket(uni, 1 << 40, blocks)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    r = katz._unpack(found.loc[found["kind"] == 0, "blob"].iloc[0], 1)[0]
    assert r.sum() == size - size // 100 and found.loc[found["kind"] == 2, "n"].sum() == (r <= 6).sum()
    assert peak < 150 * len(r)


# 7

def test_segments_are_the_maximal_ones():
    """Ruzzo and Tompa: a segment is maximal if all its proper parts score less and
    none that holds it has that property."""
    rng = random.Random(9)
    for _ in range(300):
        s = [rng.randint(-4, 4) for _ in range(rng.randrange(1, 14))]
        good = [(a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)
                if all(sum(s[a:k]) > 0 for k in range(a + 1, b + 1)) and all(sum(s[k:b]) > 0 for k in range(a, b))]
        want = [(a, b, sum(s[a:b])) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good)]
        assert toxicity.segments([(i, i + 1, x) for i, x in enumerate(s)]) == sorted(want)


def test_toxicity_in_held_out_rows(spark, sf_small):
    sf = sf_small.replace("sf0.001", "sf0.1")
    rows = (queries.op7_toxicity(spark, sf).join(load(spark, sf, "labels"), "doc_id").where("held_out")
            .groupBy("toxic", "predicted").count().collect())
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ["a b", None, ""])
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [(r["score"], r["passages"]) for r in toxicity.score(docs, model).collect()] == [(0.5, [])] * 3


def test_toxicity_keeps_every_significant_token(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(words, k=30) + (rng.choices(words[:300], k=20) if k % 5 == 0 else [])) for k in range(600)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(600)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, folds=5, held_out=7)       # no fold is held out
    seen = {}
    for k, t in enumerate(texts):
        for w in t.split():
            seen.setdefault(w, [0, 0])[k % 5 == 0] += 1
    n0, n1 = (sum(x[i] for x in seen.values()) for i in (0, 1))
    want = set()
    for w, (y0, y1) in seen.items():
        a0, a1, total = (y0 + toxicity.PRIOR * (y0 + y1), y1 + toxicity.PRIOR * (y0 + y1), toxicity.PRIOR * (n0 + n1))
        z = (math.log(a1 / (n1 + total - a1)) - math.log(a0 / (n0 + total - a0))) / math.sqrt(1 / a0 + 1 / a1)
        if abs(z) >= toxicity.LEAST_Z:
            want.add(w)
    assert set(model.weights) == want and len(want) > 200


# 8

def test_language_in_held_out_rows(spark, sf_small):
    sf = sf_small.replace("sf0.001", "sf0.01")
    got = queries.op8_language_id(spark, sf).join(load(spark, sf, "documents"), "doc_id").where("held_out")
    assert got.selectExpr("avg(int(lang = lang_pred))").first()[0] >= 0.97


def test_language_of_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "123 !?", "en"),
                                  (4, None, "fr"), (5, "", None), (8, "chat", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and got[4]["score"] == 0
    assert got[8]["lang_pred"] in ("en", "fr")
    assert langid.predict(docs, langid.learn(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_rare_language_is_learned(spark, sf_small):
    docs = load(spark, sf_small, "documents")
    own = "qaxu zolti vrenka mubosh tilqar evnosh drabu kelzim posqua".split()
    rare = [(10 ** 7 + k, " ".join(own[k * j % 9] for j in range(1, 40)), "qx", "s", 1) for k in range(1, 41)]
    both = docs.unionByName(spark.createDataFrame(rare, docs.schema))
    model = langid.learn(both, sample_rows=60, language_rows=30)
    assert "qx" in model.languages
    got = langid.predict(both.where("doc_id > 10000000"), model).collect()
    assert [r["lang_pred"] for r in got] == ["qx"] * 40


# 9

def test_edit_distance_inside():
    rng = random.Random(7)
    for _ in range(300):
        item = [rng.randrange(5) + 1 for _ in range(rng.randrange(1, 9))]
        region = [rng.randrange(6) for _ in range(rng.randrange(0, 15))]
        rows = [[0] * (len(region) + 1)]
        for i, w in enumerate(item, 1):
            rows.append([i])
            for j, x in enumerate(region, 1):
                rows[-1].append(min(rows[i - 1][j - 1] + (w != x), rows[i - 1][j] + 1, rows[i][j - 1] + 1))
        best, end = decontaminate.edit_distance_inside(item, region, len(item))
        assert best == min(rows[-1]) and (best > len(item) or rows[-1][end] == best)


def test_planted_items_are_found(spark, sf_small):
    sf = sf_small.replace("sf0.001", "sf0.1")
    items = load(spark, sf, "benchmark")
    rng = random.Random(11)
    known = [(r["item_id"], r["text"].split()) for r in items.collect()]
    known = [(i, w) for i, w in known if len(w) >= 15][:120]
    own = [w for _, ws in known for w in ws]
    rows, planted = [], set()
    for k, (item, words) in enumerate(known):
        words = list(words)
        if k % 2:       # about a tenth of the words edited
            for _ in range(len(words) // 10):
                at = rng.randrange(len(words))
                kind = rng.randrange(3)
                words[at:at + 1] = [[], ["edited"], [words[at], "added"]][kind]
        around = [rng.choice(own) for _ in range(300)]
        rows.append((k, " ".join(around[:150] + words + around[150:]).upper() if k % 3 else " ".join(words)))
        planted.add((k, item))
    clean = [(1000 + k, " ".join(rng.choice(own) for _ in range(400))) for k in range(100)]
    docs = spark.createDataFrame(rows + clean + [(5000, None), (5001, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()}
    assert not any(d >= 1000 for d, _ in got)
    assert all((k, i) in got for k, i in planted if k % 2 == 0)
    assert len(planted & got) >= 0.95 * len(planted)
    small = decontaminate.find_leaks(docs, items, block_bytes=4000).collect()       # many passes, same rows
    assert len({(r["doc_id"], r["item_id"]) for r in small} & planted) >= 0.95 * len(planted)


def test_items_are_found_up_to_the_edit_rate(spark, sf_small):
    items = load(spark, sf_small.replace("sf0.001", "sf0.1"), "benchmark")
    rng = random.Random(5)
    known = sorted(((len(r["text"].split()), r["item_id"], r["text"].split()) for r in items.collect()), reverse=True)
    own = [w for _, _, ws in known for w in ws]
    rows, planted = [], {}
    for n, item, words in known[:40] + known[-40:]:
        for kinds in ([1], [0, 1, 2], [0, 2]):      # replaced; mixed; left out and inserted
            words_now = list(words)
            for at in sorted(rng.sample(range(n), int(decontaminate.EDIT_RATE * n)), reverse=True):
                words_now[at:at + 1] = [[], ["edited"], [words[at], "added"]][rng.choice(kinds)]
            around = [rng.choice(own) for _ in range(60)]
            planted[len(rows)] = item, int(decontaminate.EDIT_RATE * n)
            rows.append((len(rows), " ".join(around[:30] + words_now + around[30:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(docs, items).collect()}
    assert all(got.get((d, i), most + 1) <= most for d, (i, most) in planted.items())


def test_leaks_equal_brute_force(spark):
    """All documents against all items, by the exact distance to any stretch."""
    rng = random.Random(31)
    pool = [f"w{i}" for i in range(60)]
    items = [(i, [rng.choice(pool) for _ in range(rng.randrange(3, 45))]) for i in range(30)]
    docs = []
    for d in range(240):
        words = [rng.choice(pool) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            part = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 2 + len(part) // 4)):
                at = rng.randrange(len(part))
                part[at:at + 1] = rng.choice([[], ["new"], [part[at], "new"], [rng.choice(pool)]])
                part = part or ["new"]
            words += part + [rng.choice(pool) for _ in range(rng.randrange(20))]
        docs.append((d, words))
    number = {w: i + 1 for i, w in enumerate([*pool, "new"])}
    want = {}
    for d, words in docs:
        for i, item in items:
            most = decontaminate.edits_of(len(item), decontaminate.EDIT_RATE)
            distance, _ = decontaminate.edit_distance_inside([number[w] for w in item], [number[w] for w in words], most)
            if distance <= most:
                want[d, i] = distance
    assert len(want) > 100 and sum(n > 0 for n in want.values()) > 30
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == want


def test_walks_reach_the_recall():
    assert decontaminate.repetitions(0.2, [14, 30, 59], 0.99) < decontaminate.MOST_WALKS
    assert decontaminate.repetitions(0.2, [14, 59], 0.5) <= decontaminate.repetitions(0.2, [14, 59], 0.99)
    assert decontaminate.repetitions(0.0, [14], 0.99) >= 1
    for n in (14, 59):      # other trials than those that chose the number
        rng = np.random.default_rng(99)
        ready = decontaminate.Items([(0, [b"%d" % i for i in range(n)])])
        base = np.array(ready.items[0])
        for kind in ("replace", "insert", "delete", "mixed"):
            seen = [decontaminate.edited(base, int(0.2 * n), kind, rng, 1000) for _ in range(200)]
            assert np.mean([len(ready.places(np.where(s >= 1000, 0, s))[0]) > 0 for s in seen]) >= 0.98


def test_short_items_and_scripts_without_spaces(spark):
    han = "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏"
    thai = "สวัสดีชาวโลกนี่คือข้อสอบ"
    items = spark.createDataFrame([(1, "What is two plus two?"), (2, han), (3, thai), (4, "yes"), (5, "...")],
                                  "item_id long, text string")
    texts = ["so: what is TWO, plus two", "what is two plus plus two", "what is two plus", "前文。" + han[:12] + "、" + han[12:] + "後文",
             "甲乙" + han[:5] + "某" + han[6:15] + han[16:] + "丙", han[::-1], "x" + thai + "y", "yes", "..."]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(docs_of(spark, texts), items).collect()}
    assert got == {(0, 1): 0, (3, 2): 0, (4, 2): 2, (6, 3): 0, (7, 4): 0}


def test_long_items_and_long_texts(spark, monkeypatch):
    rng = random.Random(2)
    item = [f"w{rng.randrange(3000)}" for _ in range(400)]
    copy = list(item)
    for at in range(0, 40):
        copy[at] = "other"      # all edits at one end
    text = " ".join([f"z{i}" for i in range(5000)] + copy + ["tail"] * 50)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None)], "item_id long, text string")
    r, = decontaminate.find_leaks(docs, items).collect()
    assert (r["doc_id"], r["item_id"], r["distance"], r["end"]) == (1, 7, 40, 5400)
    pieces = list(decontaminate._pieces(text, 10))
    monkeypatch.setattr(decontaminate, "_SPLIT", 1000)
    cut = list(decontaminate._pieces(text, 10))
    words = pieces[0][1]
    assert len(cut) > 5 and all(p == words[b:b + len(p)] for b, p in cut) and cut[-1][0] + len(cut[-1][1]) == len(words)


# 10

def tiktoken_encoding():
    import tiktoken
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANK_FILE))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_librarys(spark, sf_small, monkeypatch):
    ranks, library = tiktoken_encoding()
    docs = load(spark, sf_small, "documents").select("doc_id", "text", F.lit(1).alias("ids")).union(spark.createDataFrame(
        [(8001, None, 1), (8002, "", 1), (8003, "a" * 5000 + " \t\n  x" + "ab" * 700, 1), (8004, "\u00e9\U0001f600 <|endoftext|>'LL I'll\x85\u3000", 1),
         (8005, " " * 3000 + "\n" * 500, 1)], "doc_id long, text string, ids int"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in bpe.decode(bpe.encode(docs)).collect():
        want = library.encode_ordinary(texts[r["doc_id"]])
        assert list(memoryview(bytes(r["ids"])).cast("I")) == want
        assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]
    digests = {r["doc_id"]: r for r in queries.op10_byte_level_bpe(spark, sf_small).collect()}
    for i, r in digests.items():
        ids = np.array(library.encode_ordinary(texts[i]), dtype="<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40_000)
    monkeypatch.setattr(bpe, "WAITING", 200)
    encoder, library = bpe.Encoder(tiktoken_encoding()[0]), tiktoken_encoding()[1]
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(60)) + " the same again" for _ in range(300)]
    most = 0
    for text, ids in zip(texts, encoder.encode(texts, regex.compile(public_tokenizers.PATTERN))):
        assert list(memoryview(ids).cast("I")) == library.encode_ordinary(text)
        most = max(most, len(encoder.matches.recent) + len(encoder.matches.older))
    assert most * bpe.ENTRY < 3 * 40_000 and " again" in encoder.matches.recent


def test_bpe_latin_texts_match_alike(spark, sf_small):
    _, library = tiktoken_encoding()
    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(6)
    encoder = bpe.Encoder(tiktoken_encoding()[0])
    texts = ["".join(rng.choices(" \n\t\x1c\x85\u3000ab1.'s\u00e9", weights=[9, 2, 1, 1, 1, 1, 5, 5, 2, 2, 2, 2, 1], k=rng.randrange(30))) for _ in range(8000)]
    texts += ["  x", " x", "x ", "x  ", "a  b", "a   b", "a\n b", "a \nb", "a\n \nb", " ", "  ", "", " \n", "\n "]
    texts += ["".join(rng.choices([chr(c) for c in range(1, 256)], k=40)) for _ in range(3000)] + ["we'll I'LL\u0100 don't"]
    for text, ids in zip(texts, encoder.encode(texts, pattern)):
        assert list(memoryview(ids).cast("I")) == library.encode_ordinary(text), repr(text)
        assert not bpe._is_latin(text) or bpe._latin_twin(pattern.pattern).findall(text) == pattern.findall(text)
    assert bpe._latin_twin(r"\p{Lu}+|\d+|.") is None
    docs = load(spark, sf_small, "documents")
    both, apart = bpe.round_trip(docs), bpe.decode(bpe.encode(docs))
    assert both.columns == apart.columns and both.exceptAll(apart).count() == 0 and both.count() == apart.count()


def test_bpe_rows_and_single_matches_agree():
    ranks, library = tiktoken_encoding()
    rng = random.Random(8)
    made = ["".join(rng.choice("abcdest\u00e9\u4e2d") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    encoder = bpe.Encoder(ranks)
    packed = list(encoder.encode(made, regex.compile(public_tokenizers.PATTERN)))
    for text, p in zip(made, packed):
        assert bpe.merge(text.encode(), ranks) == list(memoryview(p).cast("I")) == library.encode_ordinary(text)


# every operator: nulls, empty texts, repeats, empty tables, clashing columns

CLASH = ["score", "id", "fp", "v", "w", "h", "n", "key", "t", "chunk", "row", "component_id", "ids", "spans", "kind"]


def odd_documents(spark):
    rows = [(1, None), (1, None), (2, ""), (3, " \n\t\n"), (None, "some text of nobody at all here"), (None, None),
            (4, "The same line of at least eight words here\nanother"), (4, "The same line of at least eight words here\nanother"),
            (5, "The same line of at least eight words here\nanother"), (6, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for i, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(None if i % 2 else i).cast("int"))
    return df


OPERATORS = {
    "quality": lambda s, d: quality.score(d, quality.learn(d, s.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None), (6, 0), (2, 0)], "doc_id long, quality int"))),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "lines": lambda s, d: line_dedup.remove_shared(d),
    "katz": lambda s, d: katz.score(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.learn(d, s.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None), (6, 0)], "doc_id long, toxic int"))),
    "language": lambda s, d: langid.predict(d, langid.learn(d.withColumn("lang", F.lit("en")))),
    "bpe": lambda s, d: bpe.decode(bpe.encode(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = odd_documents(spark)
    got = OPERATORS[name](spark, docs)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in docs.collect())
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_odd_rows_hold_no_leak(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "the same line of at least eight words here"), (1, None), (None, "a"), (2, "")], "item_id long, text string")
    leaks = decontaminate.find_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.collect()} == {(4, 1), (5, 1)}
    assert decontaminate.drop_leaking(docs, leaks).count() == docs.count() - 3
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
