"""Language identification by averaged hashed subword embeddings.

A text's byte 3- and 4-grams (in lower case, everything but letters as a word
boundary) are hashed to rows of an embedding table, averaged and passed through
a linear softmax. Both are trained by stochastic gradient descent in numpy on a
bounded sample. A temperature and a rejection level are fitted on rows that the
training has not seen. For prediction the two layers are multiplied out, so a text
costs one look-up per subword.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirrus.llm.folds import is_fold

BUCKET_BITS = 15
DIMENSIONS = 16
ORDERS = (3, 4)
#: Labelled rows that are learned from (those of least hash), and of each language at
#: least (or all that it has); a fifth of them calibrates.
SAMPLE_ROWS = 6_000
LANGUAGE_ROWS = 200
EPOCHS = 5
LEARNING_RATE = 0.5
#: Share of errors that accepted predictions may have on the calibration rows.
ACCEPTED_ERROR = 0.01
UNDETERMINED = "und"
_CHUNK = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def subwords(text: str):
    """Buckets of a whole text's subwords, in arrays of bounded length."""
    data = b" " + text.lower().encode("utf-8", "surrogatepass") + b" "
    reach = max(ORDERS) - 1
    for at in range(0, max(1, len(data) - reach), _CHUNK):
        part = _FOLD[np.frombuffer(data, dtype=np.uint8, count=min(_CHUNK + reach, len(data) - at), offset=at)]
        for n in ORDERS:
            stop = min(len(part) - n + 1, _CHUNK)
            if stop <= 0:
                continue
            h = np.full(stop, n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ part[k:k + stop]) * _MIX[k]
            yield (h ^ h >> np.uint32(15)) >> np.uint32(32 - BUCKET_BITS)


def _counts(text: str) -> np.ndarray:
    total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for buckets in subwords(text):
        total += np.bincount(buckets, minlength=1 << BUCKET_BITS)
    return total


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray           # logits of each bucket, buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for buckets in subwords(text):
            total += self.table[buckets].sum(0, dtype=np.float64)
            n += len(buckets)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated confidence, whether it is accepted)."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, False
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.reject_below)


def _shares(row: tuple[int, bytes, bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """(language, buckets, shares) of a packed row; unpacked one at a time."""
    counts = np.frombuffer(row[2], dtype="<u4").astype(np.float32)
    return row[0], np.frombuffer(row[1], dtype="<u2"), counts / counts.sum()


def train(rows: list[tuple[str, bytes, bytes]], seed: int = 1) -> LanguageModel:
    """A model of (language, buckets, counts) rows, packed as unsigned 16- and 32-bit
    integers. Every fifth row calibrates."""
    languages = tuple(sorted({lang for lang, _, _ in rows}))
    if not languages:
        return LanguageModel((), np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0))
    number = {lang: k for k, lang in enumerate(languages)}
    data = [(number[lang], b, c) for lang, b, c in rows if b]
    fit, calibrate = [d for i, d in enumerate(data) if i % 5], data[::5]
    fit = fit or data
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            y, b, c = _shares(fit[i])
            rate = LEARNING_RATE * (1 - done / steps)
            done += 1
            mean = c @ emb[b]
            z = mean @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            back = out @ g
            out -= rate * np.outer(mean, g)
            bias -= rate * 0.1 * g
            # rows of rarer subwords move less; the factor makes up for the average
            emb[b] -= (rate * 20) * c[:, None] * back
    table = (emb @ out).astype(np.float32)
    model = LanguageModel(languages, table, bias.astype(np.float64))
    if not calibrate:
        return model
    z = np.array([c @ table[b] + bias for _, b, c in map(_shares, calibrate)], dtype=np.float64)
    y = np.array([k for k, _, _ in calibrate])

    def loss(t: float) -> float:
        s = z / t
        top = s.max(1)
        return float((top + np.log(np.exp(s - top[:, None]).sum(1)) - s[np.arange(len(y)), y]).mean())

    temperature = min(np.geomspace(0.02, 10, 60).tolist(), key=loss)
    p = np.exp(z / temperature - (z / temperature).max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    order = np.argsort(-p.max(1), kind="stable")
    wrong = (p.argmax(1) != y)[order].cumsum() / np.arange(1, len(y) + 1)
    good = np.flatnonzero(wrong <= ACCEPTED_ERROR)
    level = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return LanguageModel(languages, table, model.bias, float(temperature), 0.0 if len(good) == len(y) else level)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          folds: int = 4, held_out: int = 2, sample_rows: int = SAMPLE_ROWS,
          language_rows: int = LANGUAGE_ROWS) -> LanguageModel:
    """Train on at most ``sample_rows`` documents outside the held-out fold that
    have a language and a letter, and besides on the first ``language_rows`` (by hash) of
    each language, so that a rare one is learned too; each is gathered as its distinct subword buckets
    and their counts (six bytes each, at most 2 ** BUCKET_BITS of them), however long it is."""
    @F.pandas_udf("struct<b:binary,c:binary>")
    def features(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            counts = _counts(t)
            used = np.flatnonzero(counts)
            rows.append((used.astype("<u2").tobytes(), counts[used].astype("<u4").tobytes()))
        return pd.DataFrame({"b": [b for b, _ in rows], "c": [c for _, c in rows]})

    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & ~is_fold(id_col, folds, held_out))
    keyed = usable.select(F.col(id_col).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    # the hash that sample_rows rows stay below decides, so that no text meets in one task
    order = F.xxhash64("key", "lang", "t")
    hashed = keyed.select("lang", order.alias("h")).distinct()
    level = hashed.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if level is None:
        return train([])
    # of each language the same; a row for each class of the model: a proven bound for the broadcast
    levels = (hashed.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
              .where(F.col("n") <= language_rows).groupBy(F.col("lang").alias("of")).agg(F.max("h").alias("least")))
    picked = (keyed.join(F.broadcast(levels), F.col("lang") == F.col("of"))
              .where((order <= level) | (order <= F.col("least"))).select(order.alias("h"), "lang", features("t").alias("f"))
              .dropDuplicates(["h"]).orderBy("h").collect())
    return train([(r["lang"], bytes(r["f"]["b"]), bytes(r["f"]["c"])) for r in picked])


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted), a row for each row of ``docs``. Texts that
    are null or have no letter (and all texts, if nothing could be learned) are
    ``und`` with score 0. ``accepted`` is false below the calibrated level. Other
    columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)     # 2 ** BUCKET_BITS rows of one number a language

    @F.pandas_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    return docs.select(F.col(id_col).alias(id_col), judge(F.col(text_col)).alias("j")).select(id_col, "j.*")
