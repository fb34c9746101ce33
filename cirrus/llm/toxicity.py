"""Toxic passages as maximum-scoring segments of token log-odds.

A token's weight is its log-odds between toxic and other documents under an
informative Dirichlet prior, shrunk by its standard error; a drift below zero
makes clean prose fall. Every maximal scoring segment of a text is found in one
pass (Ruzzo and Tompa). Extreme-value statistics of clean prose (Karlin and
Altschul) say how many segments of that score a clean text of that length would
have, and the significant ones add up to the document's evidence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.llm.folds import is_fold
from cirrus.llm.storage import write_table

#: Labelled rows that are learned from (those of least hash).
SAMPLE_ROWS = 40_000
#: Total of the Dirichlet prior, per token of the sample; it is spread like the sample's tokens.
PRIOR = 0.1
#: Tokens count only from so many standard errors, less one.
LEAST_Z = 2.0
DRIFT = 0.6
#: Expected number of such segments in clean prose from which one is not significant.
SIGNIFICANT = 0.1
_TOKEN = re.compile(r"\w+")
PASSAGES = "array<struct<start:int,end:int,score:double,expected:double>>"


def tokens(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _TOKEN.findall((text or "").lower())


def segments(items: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of scored stretches (start, end, score), in
    linear time: each candidate points to the last one before it that began lower."""
    found: list[list] = []      # start, end, total before, total after, link
    total = 0.0
    for start, end, score in items:
        if score <= 0:
            total += score
            continue
        new = [start, end, total, total + score]
        total += score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]       # token -> score per occurrence, without the drift
    rate: float                     # lambda of the extreme-value law
    log_k: float
    slope: float = 1.0
    offset: float = 0.0

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], float]:
        """Significant passages (first token, one past the last, score, expected
        number in clean prose of that length) and the evidence they add up to."""
        words = tokens(text)
        get = self.weights.get
        items, last = [], 0
        for i, w in enumerate(words):
            weight = get(w)
            if weight is not None:
                if i > last:
                    items.append((last, i, -DRIFT * (i - last)))
                items.append((i, i + 1, weight - DRIFT))
                last = i + 1
        out, evidence = [], 0.0
        for a, b, s in segments(items):
            log_e = self.log_k + float(np.log(max(1, len(words)))) - self.rate * s
            if log_e < np.log(SIGNIFICANT):
                out.append((a, b, float(s), float(np.exp(log_e))))
                evidence -= log_e
        return out, min(evidence, 100.0)

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.offset + self.slope * evidence, -30, 30))))


def _rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1; the scores' mean is
    negative, so it exists once a score is positive (1 otherwise)."""
    if not (scores > 0).any():
        return 1.0
    low, high = 1e-6, 1.0
    total = lambda r: float((shares * np.exp(np.minimum(r * scores, 700))).sum())
    while total(high) < 1 and high < 1e3:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return (low + high) / 2


def weigh(counts: pd.DataFrame, n1: float, n0: float) -> tuple[dict[str, float], float]:
    """(weights, rate) from (token, y1, y0) counts of toxic and other text with n1
    and n0 tokens: log-odds with a Dirichlet prior, one standard error off."""
    y1, y0 = counts["y1"].to_numpy(float), counts["y0"].to_numpy(float)
    prior, total = PRIOR * (y1 + y0), PRIOR * (n1 + n0)
    a1, a0 = y1 + prior, y0 + prior
    delta = np.log(a1 / (n1 + total - a1)) - np.log(a0 / (n0 + total - a0))
    error = np.sqrt(1 / a1 + 1 / a0)
    ok = np.abs(delta) >= LEAST_Z * error
    shrunk = np.sign(delta) * np.maximum(np.abs(delta) - error, 0)
    shares = a0 / (n0 + total)
    rate = _rate(np.append(shrunk[ok] - DRIFT, -DRIFT), np.append(shares[ok], max(0.0, 1 - shares[ok].sum())))
    return dict(zip(counts["token"][ok], shrunk[ok].tolist())), rate


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, by Newton steps with a small ridge."""
    w = np.zeros(2)
    z = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w += np.linalg.solve(h, z.T @ (y - p) - 1e-2 * w)
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", folds: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from labelled documents outside the held-out fold, at most
    ``sample_rows``: weights from all of them; weights from one half of them (by hash)
    are calibrated on the other. Null labels and null ids are left out; of several labels for one id the
    largest counts. With no toxic label (or only toxic ones) no token has a weight and every
    score is the smoothed share of toxic labels."""
    marked = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_fold(id_col, folds, held_out))
              .groupBy(F.col(id_col).alias("key")).agg((F.max(label_col) > 0).cast("int").alias("y"))
              .orderBy(F.xxhash64("key"), "key").limit(sample_rows))

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([tokens(t) for t in texts], dtype=object)

    # at most sample_rows pairs of numbers: a proven bound for the broadcast
    sample = (docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("t"))
              .join(F.broadcast(marked), "key").withColumn("half", F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(2))))
    seen, _ = write_table(
        sample.select("y", "half", F.explode(split("t")).alias("token")).groupBy("token").agg(
            *[F.sum(F.when(F.col("half") == 0, F.col("y") == k).otherwise(False).cast("long")).alias(f"half{k}") for k in (0, 1)],
            *[F.sum((F.col("y") == k).cast("long")).alias(f"all{k}") for k in (0, 1)]), "token-counts")

    def lexicon(part: str) -> tuple[dict[str, float], float]:
        y1, y0 = F.col(f"{part}1"), F.col(f"{part}0")
        n1, n0 = (float(x or 0) for x in seen.agg(F.sum(y1), F.sum(y0)).first())
        if not n1 or not n0:
            return {}, 1.0
        # the z of weigh(), a hair wider so that rounding loses none: every token that has a
        # weight, and no other, reaches the driver
        prior, total = PRIOR * (y1 + y0), PRIOR * (n1 + n0)
        a1, a0 = y1 + prior, y0 + prior
        delta = F.log(a1 / (n1 + total - a1)) - F.log(a0 / (n0 + total - a0))
        wide = F.when(y1 + y0 > 0, F.abs(delta) >= (LEAST_Z - 1e-6) * F.sqrt(1 / a1 + 1 / a0))
        return weigh(seen.where(wide).select("token", y1.alias("y1"), y0.alias("y0")).orderBy("token").toPandas(), n1, n0)

    weights, rate = lexicon("half")
    draft = ToxicityModel(weights, rate, 0.0)

    @F.pandas_udf("struct<best:double,n:int>")
    def best(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            n = len(tokens(t))
            found, _ = ToxicityModel(draft.weights, draft.rate, -1e9).passages(t)
            rows.append((max([s for _, _, s, _ in found], default=0.0), n))
        return pd.DataFrame(rows, columns=["best", "n"])

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series([fitted.passages(t)[1] for t in texts], dtype=float)

    other = sample.where("half = 1")
    # Gumbel: the mean of rate * best - ln n is ln K plus Euler's constant
    mean = other.where("y = 0").select(best("t").alias("x")).where("x.n > 0").agg(
        F.avg(F.lit(rate) * F.col("x.best") - F.log("x.n"))).first()[0]
    fitted = ToxicityModel(weights, rate, float(mean if mean is not None else 0.0) - 0.5772)
    judged = other.groupBy(evidence("t").alias("e"), "y").agg(F.count(F.lit(1)).alias("n")).orderBy("e", "y").limit(
        2 * sample_rows).collect()
    x, y = np.array([r["e"] for r in judged]), np.array([r["y"] for r in judged], dtype=float)
    n = np.array([r["n"] for r in judged], dtype=int)
    share = (n @ y + 1) / (n.sum() + 2) if len(n) else 0.5
    if not weights or not len(n) or y.min() == y.max():
        slope, offset = (1.0 if weights else 0.0), float(np.log(share / (1 - share)))
    else:
        slope, offset = _platt(np.repeat(x, n), np.repeat(y, n))
    # the calibration of one half's weights holds for those of the whole sample
    return ToxicityModel(lexicon("all")[0], rate, fitted.log_k, max(slope, 0.0), offset)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, passages), a row for each row of ``docs``. A passage
    has its first token, one past its last, its score and the number of such
    passages that clean prose of that length would have. Null and empty texts have
    no passage; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)     # the significant tokens of a bounded sample

    @F.pandas_udf(f"struct<score:double,passages:{PASSAGES}>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = [shared.value.passages(t) for t in texts]
        return pd.DataFrame({"score": [shared.value.probability(e) for _, e in rows],
                             "passages": [[{"start": a, "end": b, "score": s, "expected": x} for a, b, s, x in found]
                                          for found, _ in rows]})

    return (docs.select(F.col(id_col).alias(id_col), judge(F.col(text_col)).alias("j"))
            .select(id_col, "j.score", (F.col("j.score") >= 0.5).cast("int").alias("predicted"), "j.passages"))
