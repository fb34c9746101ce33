"""The pipeline on the smallest tables, each stage against a plain version of it."""

import hashlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from cirrus.llm import quality
from cirrus.sources.tables import load
from tests.llm.test_llm_operators import brute_fingerprint, tiktoken_encoding, union_find


def test_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found and {f"op{n}_" for n in range(1, 11)} <= {k[:k.index("_") + 1] for k in found if k.startswith("op")}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontamination", "bpe"]


def test_stages(spark, sf_small):
    docs = load(spark, sf_small, "documents")
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = stage(spark, now, sf_small).cache()
        if name != "bpe":
            assert steps[name].columns == docs.columns
            now = steps[name]
    text = {k: {r["doc_id"]: r["text"] for r in v.collect()} for k, v in steps.items() if k != "bpe"}
    first = {r["doc_id"]: r["text"] for r in docs.collect()}
    # quality: what its scores say
    scores = quality.score(docs, quality.learn(docs, load(spark, sf_small, "labels")))
    assert set(text["quality"]) == {r["doc_id"] for r in scores.collect() if r["predicted"] == 1}
    assert len(text["quality"]) >= 0.7 * len(first)
    # line dedup: no text grows, no long line is in two documents, nothing is lost
    for i, t in text["line_dedup"].items():
        assert not Counter(t.split("\n")) - Counter(first[i].split("\n"))
    words = lambda d: {x.strip() for t in d.values() for x in t.split("\n")}
    assert words(text["line_dedup"]) == words(text["quality"])
    # simhash: the smallest of each class
    prints = {i: brute_fingerprint(t) for i, t in text["line_dedup"].items()}
    ids = sorted(prints)
    parts = union_find(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert set(text["simhash"]) == {i for i, c in parts.items() if i == c}
    # decontamination: no item is left word by word, and what went held one
    items = [" ".join(r["text"].lower().split()) for r in load(spark, sf_small, "benchmark").collect()]
    holds = {i for i, t in text["simhash"].items() if any(x in " ".join(t.lower().split()) for x in items)}
    assert set(text["simhash"]) - set(text["decontamination"]) >= holds
    assert len(set(text["simhash"]) - set(text["decontamination"]) - holds) <= 0.02 * len(text["simhash"])
    # ids: the library's
    _, library = tiktoken_encoding()
    got = {r["doc_id"]: r for r in steps["bpe"].collect()}
    assert set(got) == set(text["decontamination"])
    for i, t in text["decontamination"].items():
        packed = b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(t))
        assert got[i]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
    whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf_small).collect()}
    assert whole == {i: r["ids_sha256"] for i, r in got.items()}


def test_odd_documents(spark, sf_small):
    docs = load(spark, sf_small, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (7001, "", "en", "s", 0),
                                 (7002, "", "en", "s", 0), (7003, None, "en", "s", 0)], docs.schema)
    clash = docs.limit(40).union(odd).union(docs.limit(5)).withColumn("score", F.lit(1)).withColumn("component_id", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, clash, sf_small)
        assert done.count() <= clash.count()
        if name != "bpe":
            assert done.columns == clash.columns
        assert stage(spark, clash.limit(0), sf_small).count() == 0
        if name == "simhash":
            ids = [r["doc_id"] for r in done.collect()]
            assert ids.count(None) == 2 and len(set(ids) - {None}) == len(ids) - 2
