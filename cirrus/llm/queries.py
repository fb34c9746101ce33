"""The operators on the shared tables: ``QUERIES`` and, where SQL can express
one, ``ORACLE_SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrus.llm import (alignment, bpe, centroids, decontaminate, embedding_dedup, katz, langid, line_dedup, mixing, quality,
                        simhash, toxicity, url_filter)
from cirrus.llm.folds import is_fold
from cirrus.operators.jobs import spread
from cirrus.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; an input with fewer splits than cores is dealt out once."""
    return spread(load(spark, sf_dir, "documents"))


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_quality_classifier(spark, sf_dir):
    """Quality of every document by a sparse rule ensemble."""
    docs = _documents(spark, sf_dir)
    model = quality.learn(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", is_fold("doc_id", 3, 1).alias("held_out"), "score", "predicted")


@_query
def op2_simhash_near_dedup(spark, sf_dir):
    """SimHash classes of all documents (three words, three bits)."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


@_query
def op3_embedding_near_dedup(spark, sf_dir):
    """Links and classes of all vectors at a cosine of 0.98 or more."""
    return embedding_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


#: (host, path, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@_query
def op4_url_filter(spark, sf_dir):
    """The verdict on every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(load(spark, sf_dir, "pages"), rules)


ORACLE_SQL["op4_url_filter"] = """
WITH rules(rh, rp, rv) AS (VALUES %s),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
bare AS (SELECT page_id, regexp_extract(rest, '^[^?#]*', 0, 's') AS rest FROM cut),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*', 0, 's'),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 substr(rest, length(regexp_extract(rest, '^[^/]*', 0, 's')) + 1) AS path FROM bare),
fits AS (SELECT DISTINCT p.host, p.path, rh || rp AS rule, rv, length(rh || rp) AS n, length(rh) AS nh
         FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules
         ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)),
best AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY n DESC, nh DESC) = 1)
SELECT page_id, p.host, p.path, rule, coalesce(rv, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
""" % ", ".join(str(r) for r in URL_RULES)


@_query
def op5_line_dedup(spark, sf_dir):
    """All documents without the passages that an earlier one holds; texts as digests."""
    return line_dedup.remove_shared(_documents(spark, sf_dir)).select(
        "doc_id", "lines_removed", "words_removed", F.sha2("text", 256).alias("text_sha256"))


@_query
def op6_katz_lm(spark, sf_dir):
    """Katz and base log10 probability of every document."""
    return katz.score(_documents(spark, sf_dir))


@_query
def op7_toxicity(spark, sf_dir):
    """Toxicity of every document, with its significant passages."""
    docs = _documents(spark, sf_dir)
    model = toxicity.learn(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", is_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted",
        F.size("passages").cast("long").alias("n_passages"))


@_query
def op8_language_id(spark, sf_dir):
    """The language of every document."""
    docs = _documents(spark, sf_dir)
    return langid.predict(docs, langid.learn(docs)).select(
        "doc_id", is_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "accepted")


@_query
def op9_benchmark_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, with the closest stretch of each."""
    return decontaminate.find_leaks(_documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))


@_query
def op10_byte_level_bpe(spark, sf_dir):
    """Ids and round trip of every document under the 50k byte-level ranks."""
    done = bpe.round_trip(_documents(spark, sf_dir))
    return done.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op11_source_mixing(spark, sf_dir):
    """The words that a mix of all sources, weighted 5, 2, 1 in turn, takes of every document."""
    mixed = mixing.taken(mixing.mix(load(spark, sf_dir, "documents")))
    return mixed.withColumnRenamed("id", "doc_id")


@_query
def op12_centroid_clustering(spark, sf_dir):
    """Eight clusters of all vectors after ten rounds, with inertia and centroid digests."""
    return centroids.with_inertia(*centroids.cluster(load(spark, sf_dir, "embeddings")))


def _centroid_sql(rounds: int = 10) -> str:
    """Lloyd's rounds spelt out, a pair of common tables each."""
    floor_mean = "(s - ((s %% n) + n) %% n) // n".replace("%%", "%")
    sql = ["""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64)""",
           """x AS MATERIALIZED (SELECT vec_id, unnest(v) AS q, generate_subscripts(v, 1) AS i FROM kept)""",
           """c0 AS MATERIALIZED (SELECT cluster, unnest(v) AS q, generate_subscripts(v, 1) AS i FROM
           (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS cluster FROM kept) WHERE cluster < 8)"""]
    for r in range(rounds + 1):
        sql.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, cluster, d FROM
            (SELECT vec_id, cluster, sum((x.q - c.q) * (x.q - c.q)) AS d FROM x JOIN c{r} c ON x.i = c.i GROUP BY vec_id, cluster)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1)""")
        if r < rounds:
            sql.append(f"""c{r + 1} AS MATERIALIZED (SELECT cluster, i, coalesce({floor_mean}, q) AS q FROM c{r} LEFT JOIN
            (SELECT cluster, i, sum(q)::HUGEINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY cluster, i)
            USING (cluster, i))""")
    return f"""WITH {", ".join(sql)},
        digests AS (SELECT cluster, sha256(string_agg(q::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
        SELECT vec_id, cluster::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN digests USING (cluster)"""


ORACLE_SQL["op12_centroid_clustering"] = _centroid_sql()


@_query
def op13_token_alignment(spark, sf_dir):
    """Links between the tokens of two tokenizers in all documents."""
    return alignment.align(_documents(spark, sf_dir))
