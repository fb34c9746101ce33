"""URL filter by hashed host-suffix and path-prefix expressions.

Each URL is expanded into the domains it belongs to times the folders its path lies
in, at those depths that occur among the rules, so that a URL of a million folders is
no more work than its length. An expression's SHA-256 digest is looked up by its first
four bytes (an equi-join; the digest itself does not travel), then the full digest and
the rest of the rule's path are confirmed, and the longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest that the join compares (four bytes).
PREFIX = 8
DEFAULT_VERDICT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
    lower case. Path: from there up to ``?``, ``#`` or the end. Both are empty for
    a null URL or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def _folder(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def _digest(host: Column, folder: Column) -> Column:
    # hosts hold no slash, so the line break keeps ("a", "b/") and ("ab/", "") apart
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _depth(path: Column) -> Column:
    """How many folders a path names, one for each slash."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _expression(host: str, path: str, labels: str, depth: str) -> Column:
    """Digest of the domain of the host's last ``labels`` labels with the path's first
    ``depth`` folders."""
    folder = F.when(F.col(depth) == 0, F.lit("")).otherwise(F.concat(F.expr(f"substring_index({path}, '/', {depth})"), F.lit("/")))
    return _digest(F.expr(f"substring_index({host}, '.', -{labels})"), folder)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = DEFAULT_VERDICT) -> DataFrame:
    """(id, host, path, rule, verdict), a row for each row of ``pages``.

    ``rules`` has (host, path, verdict). A rule fits a URL if the URL's host is the
    rule's or below it and the URL's path starts with the rule's. Of those that fit,
    the longest (host and path together) wins, then the one with the longer host,
    then ``block`` before any other verdict. Without one, rule is null and the
    verdict ``default``. Hosts of rules are compared in lower case; rules with a null
    are ignored; repeated rows are judged one by one; other columns are ignored.

    Each distinct host and path is expanded once, however many pages share it, and only
    to the (labels, folders) that the rules have; that list, of a few numbers, is
    read from the rules first. The rows that reach the join with the pages are one per
    distinct URL.
    """
    host, path = host_and_path(F.col(url_col))
    keyed = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    listed = (rules.where("host is not null and path is not null and verdict is not null")
              .select(F.lower("host").alias("rule_host"), F.col("path").alias("rule_path"),
                      F.col("verdict").alias("rule_verdict"))
              .withColumn("rule_digest", _digest(F.col("rule_host"), _folder(F.col("rule_path"))))
              .withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX)))
    shapes = listed.select(_labels(F.col("rule_host")).alias("labels"), _depth(F.col("rule_path")).alias("depth")).distinct().collect()
    # the rules' shapes, not the pages'
    wanted = F.array(*[F.struct(F.lit(r["labels"]).alias("labels"), F.lit(r["depth"]).alias("depth")) for r in sorted(shapes)])
    expr = keyed.select("host", "path").distinct()
    if shapes:
        expr = (expr.select("host", "path", _labels(F.col("host")).alias("_n"), _depth(F.col("path")).alias("_d"), F.explode(wanted).alias("x"))
                .where("x.labels <= _n and x.depth <= _d").select("host", "path", "x.labels", "x.depth"))
    else:
        expr = expr.select("host", "path", F.lit(0).alias("labels"), F.lit(0).alias("depth")).where("false")
    digest = _expression("host", "path", "labels", "depth")
    expr = expr.withColumn("prefix", F.substring(digest, 1, PREFIX))
    best = F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"),
                          F.length("rule_host").alias("nh"), (F.col("rule_verdict") == "block").alias("b"),
                          F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")))
    # the digests have one length, so that one starts with the other confirms that they are equal
    judged = (expr.join(listed, (F.col("prefix") == F.col("rule_prefix"))
                        & F.startswith(digest, F.col("rule_digest"))
                        & F.expr("startswith(path, rule_path)"))
              .groupBy("host", "path").agg(best.alias("best"))
              .select(F.concat("host", F.lit("\n"), "path").alias("k"), "best"))
    # the joint key is an expression of its own, so AQE may split a URL that very many pages share
    return (keyed.join(judged, F.concat("host", F.lit("\n"), "path") == F.col("k"), "left")
            .select(id_col, "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
