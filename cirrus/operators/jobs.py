"""Batch data jobs: word count, map/reduce with user programs, total-order sort,
row generation.

All of them keep the heavy work distributed: tokens are counted with a partial
(map-side) aggregate, user mappers run over pieces of Arrow batches in
``mapInPandas`` and combine locally before the shuffle, and the total-order sort
range-partitions on (key, tiebreak) so that a key holding a third of the rows still
spreads over several partitions.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Delimiters of a Java StringTokenizer (the word-count example's tokenizer).
TOKENIZER_DELIMS = "[ \\t\\n\\r\\f]+"
#: awk's default field splitting: runs of blanks and tabs; records are lines.
AWK_DELIMS = "[ \\t\\n]+"


def spread(df: DataFrame) -> DataFrame:
    """Give per-row heavy work (tokenising whole texts, user programs) at least
    one partition per core. Only an input with fewer splits than cores (one
    large row group, say) is redistributed; a large input keeps its splits and
    pays no extra shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tokens(text: Column, delims: str = TOKENIZER_DELIMS) -> Column:
    """Array of non-empty tokens of the whole text (``array_remove`` keeps the
    expression in generated code; a lambda filter would not)."""
    return F.array_remove(F.split(text, delims), "")


def word_count(df: DataFrame, text_col: str, delims: str = TOKENIZER_DELIMS) -> DataFrame:
    """(word, count) over whole texts; hot words are combined map-side."""
    return (spread(df.select(text_col)).select(F.explode(tokens(F.col(text_col), delims)).alias("word"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("count")))


# --- user mapper / reducer programs ------------------------------------------------------

#: Parts into which a key's partial values are dealt before a user's reducer.
SPREAD = 64

#: Bytes of a batch that a mapper gets at a time. A batch has up to 10,000 rows, whole
#: texts maybe, and a mapper makes many times the bytes it is given.
PIECE_BYTES = 2 << 20

Mapper = Callable[[pd.DataFrame], pd.DataFrame]


def pieces(pdf: pd.DataFrame, most: int = PIECE_BYTES) -> Iterator[pd.DataFrame]:
    """All rows of ``pdf`` in order, cut where the values (as pandas' deep memory usage
    counts them) pass a multiple of ``most``: a piece has less than that and one row."""
    size = np.zeros(len(pdf), dtype=np.int64)
    for _, column in pdf.items():
        fixed = isinstance(column.dtype, np.dtype) and column.dtype != object
        size += column.dtype.itemsize if fixed else [sys.getsizeof(x) for x in column]
    nth = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(nth)) + 1), len(pdf)]
    for a, b in zip(cuts, cuts[1:]):
        yield pdf.iloc[a:b].reset_index(drop=True)


def map_reduce(df: DataFrame, mapper: Mapper, out_schema: str, key: str, value: str,
               reduce: str | Callable[[pd.Series], object] = "sum") -> DataFrame:
    """Run a user mapper over Arrow batches, combine its (key, value) output
    inside each piece of a batch, then reduce per key with a Spark aggregate.

    The mapper is plain pandas (DataFrame in, DataFrame with ``key``/``value`` out),
    the stand-in for an external mapper program. It is called for each of a batch's
    :func:`pieces`, so that its memory goes by the bytes of a piece and not by the rows
    of a batch. The reducer must be associative so
    it can run map-side as a combiner: ``sum``, ``min``, ``max`` and ``count`` end in a
    Spark hash aggregate, so no key's values are ever gathered in one place; a
    program of the user's own (values of one key in, one value out) first combines
    each piece, then each of SPREAD parts of a key's partial values, then those. A null key is a key like any other.
    """
    combine = reduce if callable(reduce) else {"sum": "sum", "min": "min", "max": "max", "count": "sum"}[reduce]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chain.from_iterable(map(pieces, batches)):     # holds no batch while the next one is read
            out = mapper(pdf)
            if reduce == "count":
                out = out.assign(**{value: 1})
            if len(out):
                yield out.groupby(key, as_index=False, sort=False, dropna=False)[value].agg(combine)

    partial = spread(df).mapInPandas(run, out_schema)
    if callable(reduce):
        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf.iloc[:1].assign(**{value: [reduce(pdf[value])]})[[key, value]]

        spread_out = partial.select(key, value, F.pmod(F.spark_partition_id(), F.lit(SPREAD)).alias("_part"))
        parts = spread_out.groupBy(key, "_part").applyInPandas(fold, out_schema)
        return parts.groupBy(key).applyInPandas(fold, out_schema)
    final = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}[reduce]
    return partial.groupBy(key).agg(final(value).alias(value))


def awk_word_mapper(text_col: str) -> Mapper:
    """Mapper splitting each line on blanks and emitting (word, 1)."""
    def mapper(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf[text_col].dropna().str.replace("\t", " ", regex=False).str.replace("\n", " ", regex=False)
        return pd.DataFrame({"word": [w for text in texts for w in text.split(" ") if w], "count": 1})
    return mapper


# --- total-order sort ------------------------------------------------------------------

def total_order_sort(df: DataFrame, key: str, partitions: int, tiebreak: list[str] | None = None) -> DataFrame:
    """Range-partition by sampled boundaries and sort inside each partition: the
    concatenation of partitions in order is globally sorted by ``key``.

    Spark samples the key distribution to pick boundaries (as the sampling
    partitioner of a total-order sort does). The tiebreak columns (default: a
    hash of the row) make equal keys splittable across partitions, so a key
    holding a third of the rows does not land in a single task."""
    tb = [F.col(c) for c in tiebreak] if tiebreak else [F.xxhash64(*[F.col(c) for c in df.columns])]
    return df.repartitionByRange(partitions, F.col(key), *tb).sortWithinPartitions(F.col(key), *tb)


# --- generated rows ----------------------------------------------------------------------

GEN_MULT = 48271               # Park-Miller "minimal standard" multiplier
GEN_MOD = 2147483647           # 2^31 - 1; id * GEN_MULT stays in a long up to ~1.9e14 rows


ROWS_PER_GEN_PARTITION = 5_000_000


#: Syllables of generated words, built from a rule (consonant + vowel).
SYLLABLES = [c + v for c in "bdklmnprst" for v in "aeiou"]


def _mix(c: Column) -> Column:
    return (c * F.lit(GEN_MULT)) % F.lit(GEN_MOD)


_SYLLABLE_TEXT = "".join(SYLLABLES)   # every syllable is two characters


def word_from_hash(h: str) -> Column:
    """A pronounceable word of two or three syllables chosen by the hash column
    ``h``: syllables are cut out of one string with integer arithmetic, a small
    expression that stays in generated code even when eight of them make a text."""
    n = len(SYLLABLES)

    def pick(k: int) -> str:
        idx = f"`{h}` % {n}" if k == 0 else f"(`{h}` div {n ** k}) % {n}"
        return f"substring('{_SYLLABLE_TEXT}', cast({idx} AS INT) * 2 + 1, 2)"
    return F.expr(f"concat({pick(0)}, {pick(1)}, if(`{h}` % 3 = 0, {pick(2)}, ''))")


def with_text(df: DataFrame, id_col: str = "id", words: int = 8, name: str = "text") -> DataFrame:
    """Add generated text of ``words`` words per row (the random-text writer).
    The per-word hashes are materialised in a first projection, so the text
    expression only references them and stays small enough for generated code."""
    hashes = [_mix(F.col(id_col) * words + j).alias(f"_h{j}") for j in range(words)]
    staged = df.select("*", *hashes)
    text = F.concat_ws(" ", *[word_from_hash(f"_h{j}") for j in range(words)])
    return staged.select(*df.columns, text.alias(name))


def gen_rows(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """``n`` sortable rows (id, 10-digit pseudo-random key, payload, generated
    text), generated in parallel by ``spark.range``; deterministic, so reruns and lost tasks
    regenerate identical rows. By default there are enough partitions for at
    most ``ROWS_PER_GEN_PARTITION`` rows each (and at least one per core)."""
    if partitions is None:
        partitions = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_GEN_PARTITION))
    r = spark.range(0, n, 1, partitions)
    key = F.lpad(((F.col("id") * F.lit(GEN_MULT)) % F.lit(GEN_MOD)).cast("string"), 10, "0")
    # text first, then the narrow columns: this order keeps the stage's
    # generated code compact (measured 3x faster than the reverse)
    return with_text(r).select("id", key.alias("key"),
                               F.concat(F.lit("payload-"), F.col("id").cast("string")).alias("payload"), "text")
