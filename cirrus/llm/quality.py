"""Quality by a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on the statistics of labelled documents. Every
path from a root to a node is a rule (a conjunction of thresholds). A logistic
regression with an L1 penalty keeps a few rules and weighs them, and the model is
compiled into one Spark column over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirrus.llm.folds import is_fold

STATISTICS = ("chars", "words", "lines", "word_bytes", "line_words", "upper", "digits", "stops", "bangs",
              "symbols", "beyond_ascii", "distinct_words", "distinct_lines", "long_words", "short_words", "ended_lines")
#: Labelled rows the trees and the weights are fitted on (those of least hash): the
#: bound of what is gathered on the driver, 17 numbers a row.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 30, 3, 32, 0.3
#: L1 penalty of the weights, on the mean log loss.
PENALTY = 5e-4
MIN_SHARE = 0.002

_CLASS = np.full(256, 5, dtype=np.int64)        # symbols, control characters
_CLASS[[*b"abcdefghijklmnopqrstuvwxyz"]] = 0
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[*b"0123456789"]] = 2
_CLASS[[*b".,;:"]] = 3
_CLASS[[*b"!?"]] = 4
_CLASS[[*b" \t\n\x0b\x0c\r"]] = 6
_CLASS[128:] = 7


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; all zero for a null, empty or blank one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256), minlength=8)
    size, black = np.fromiter(map(len, words), dtype=np.int64, count=len(words)), len(data) - kinds[6]
    lines = [line for line in data.split(b"\n") if line.strip()]
    n = len(words)
    return [float(x) for x in (
        len(text), n, len(lines), size.mean(), n / len(lines), kinds[1] / black, kinds[2] / black, kinds[3] / black,
        kinds[4] / black, kinds[5] / black, kinds[7] / black, len(set(words)) / n, len(set(lines)) / len(lines),
        (size >= 12).mean(), (size <= 3).mean(), sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines))]


@F.pandas_udf(T.ArrayType(T.DoubleType()))      # a type, for the module is imported by workers too
def text_statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts], dtype=object)


Rule = tuple[tuple[int, bool, float], ...]      # (statistic, whether above, threshold)


def _grow(binned: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray,
          out: np.ndarray) -> set[Rule]:
    """One tree on the gradient; adds its leaves' steps to ``out``, returns its paths."""
    paths: set[Rule] = set()
    todo = [((), np.arange(len(slope)))]
    while todo:
        path, rows = todo.pop()
        if path:
            paths.add(tuple(sorted(path)))
        best = (1e-9, None)
        total, n = slope[rows].sum(), len(rows)
        if len(path) < DEPTH:
            for k, cut in enumerate(cuts):
                if not len(cut):
                    continue
                bins = binned[rows, k]
                g = np.bincount(bins, slope[rows], len(cut) + 1).cumsum()[:-1]
                m = np.bincount(bins, minlength=len(cut) + 1).cumsum()[:-1]
                ok = (m >= 5) & (n - m >= 5)
                gain = np.where(ok, g * g / np.maximum(m, 1) + (total - g) ** 2 / np.maximum(n - m, 1) - total ** 2 / n, 0)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (k, at))
        if best[1] is None:
            out[rows] += RATE * total / max(curve[rows].sum(), 1e-6)
            continue
        k, at = best[1]
        above = binned[rows, k] > at
        for side in (False, True):
            todo.append(((*path, (k, side, float(cuts[k][at]))), rows[above == side]))
    return paths


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, k] > t) == above for k, above, t in rule])


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps (FISTA)."""
    n = len(y)
    w, b = np.zeros(z.shape[1]), 0.0
    v, c, t = w.copy(), b, 1.0
    vector = np.ones(z.shape[1])
    for _ in range(20):     # the largest eigenvalue, for the step
        vector = z.T @ (z @ vector) / n
        vector /= max(np.linalg.norm(vector), 1e-12)
    step = 4 / (np.linalg.norm(z.T @ (z @ vector)) / n + 1)
    for _ in range(400):
        g = (1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y) / n
        w1 = v - step * (z.T @ g)
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * penalty, 0)
        b1, t1 = c - step * g.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, b


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules and an intercept; ``score`` compiles them."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self, stats: Column) -> Column:
        """The probability of label 1, as a column over an array of STATISTICS."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = reduce(lambda a, b: a & b, [stats[k] > t if above else stats[k] <= t for k, above, t in rule])
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleModel:
    """The model of labelled statistics. With labels of one kind only (or none), no
    rules: the score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return RuleModel((), base)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)])
    margin, rules = np.full(len(y), base), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rules |= _grow(binned, cuts, y - p, p * (1 - p), margin)
    named = sorted(rules)
    if not named:
        return RuleModel((), base)
    z = np.column_stack([_holds(r, x) for r in named]).astype(np.float64)
    common = (z.mean(0) >= MIN_SHARE) & (z.mean(0) <= 1 - MIN_SHARE)
    named, z = [r for r, ok in zip(named, common) if ok], z[:, common]
    if not named:
        return RuleModel((), base)
    w, b = _lasso(z, y, penalty)
    return RuleModel(tuple((r, float(x)) for r, x in zip(named, w) if abs(x) > 1e-6), float(b))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", folds: int = 3, held_out: int = 1, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on labelled documents outside the held-out fold.

    At most ``sample_rows`` of them are used, those whose ids hash least. Null
    labels and null ids are left out; of several labels for one id the largest
    counts; a repeated document counts once for each of its texts.
    """
    marked = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_fold(id_col, folds, held_out))
              .groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).cast("double").alias("y"))
              .orderBy(F.xxhash64("key"), "key").limit(sample_rows))
    # at most sample_rows pairs of numbers: a proven bound for the broadcast
    rows = (docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("t")).join(F.broadcast(marked), "key")
            .select("key", "y", text_statistics("t").alias("x")).distinct()
            .orderBy(F.xxhash64("key"), "key", "x").limit(sample_rows).collect())
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(-1, len(STATISTICS))
    return fit_rules(x, np.array([r["y"] > 0 for r in rows], dtype=np.float64))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted), a row for each row of ``docs``: the probability of
    label 1, and whether it is at least a half. Null and empty texts are scored by
    statistics that are all zero; other columns are ignored."""
    scored = docs.select(F.col(id_col).alias(id_col), model.score(text_statistics(F.col(text_col))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The rows whose score is at least a half, all columns as they are."""
    return docs.where(model.score(text_statistics(F.col(text_col))) >= 0.5)
