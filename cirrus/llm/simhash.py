"""SimHash near-duplicates with pigeonring filtering.

Two 64-bit fingerprints at most three bits apart, cut into a ring of four
16-bit segments, must have a segment from which every chain of k consecutive
segments differs in at most 3 * k / 4 bits: none in the first segment, at most
one in the first two, two in three. The first two conditions are the blocking
key (equal first segment, one equal half of the second); the longer chains prune
what shares a block before the full distance is taken.

Only distinct fingerprints are compared, and a block returns a spanning forest of
its links, never all pairs. Blocks above ``BLOCK`` fingerprints are divided again
by the bits that are still free (the same pigeonhole argument), and what stays
large is compared in pairs of tiles, so that no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.llm.components import connected_components
from cirrus.llm.storage import write_table

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints that one comparison holds at a time.
BLOCK = 2048
#: Words hashed at a time, so that a very long text needs bounded memory.
CHUNK = 200_000
SEGMENTS = 4
WIDTH = 16
_ALL = (1 << 64) - 1


def _lower_words(text: str) -> list[bytes]:
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and space, tab to CR
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: a bit is set if more than half of the shingles'
    hashes have it. Null, empty or blank texts give zero."""
    words = _lower_words(text or "")
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, CHUNK):
        part = words[at:at + CHUNK + shingle - 1]
        runs = zip(*(part[k:] for k in range(shingle))) if len(part) >= shingle else [part]
        hashes = np.array([digest(join(run), SEED) for run in runs], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias(id_col), simhash(F.col(text_col)).alias("fp"))


def _first_masks() -> list[int]:
    """Bits that a block shares: a segment and half of the next one on the ring."""
    masks = []
    for i in range(SEGMENTS):
        base, after = i * WIDTH, (i + 1) % SEGMENTS * WIDTH
        for half in (0, WIDTH // 2):
            masks.append(((1 << WIDTH) - 1) << base | ((1 << WIDTH // 2) - 1) << (after + half))
    return masks


def _finer(mask: int) -> list[int]:
    """Masks that also fix one of MAX_BITS + 1 parts of the bits still free."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k::MAX_BITS + 1]) for k in range(MAX_BITS + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fps: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """(start, mask, value, fp): a row for each fingerprint and mask; start is the
    first segment of the chain that the mask stands for."""
    listed = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(_signed(m)).alias("mask")) for s, m in masks])
    return (fps.select("fp", F.explode(listed).alias("x"))
            .select("x.start", "x.mask", F.col("fp").bitwiseAND(F.col("x.mask")).alias("value"), "fp"))


def _linked(one: np.uint64, many: np.ndarray, start: int) -> np.ndarray:
    """Which of ``many`` link with ``one``: chains of two and three segments from
    ``start`` first, then the whole distance."""
    diff, at = many ^ one, np.arange(len(many))
    bits = np.zeros(len(many), dtype=np.uint8)
    for k in range(SEGMENTS):
        shift = np.uint64((start + k) % SEGMENTS * WIDTH)
        bits = bits + np.bitwise_count(diff >> shift & np.uint64((1 << WIDTH) - 1))
        ok = bits <= MAX_BITS * (k + 1) // SEGMENTS
        diff, at, bits = diff[ok], at[ok], bits[ok]
    return at


def _forest(left: np.ndarray, right: np.ndarray | None, start: int) -> list[tuple[int, int]]:
    """Links that span what ``left`` (with ``right``, if given: only across) connects.
    A fingerprint that was reached leaves the candidates."""
    out = []
    if right is None:
        rest = left
        while len(rest):
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                one = frontier.pop()
                hit = _linked(one, rest, start)
                if len(hit):
                    out += [(one, x) for x in rest[hit]]
                    frontier += list(rest[hit])
                    rest = np.delete(rest, hit)
        return out
    sides = [left, right]
    while len(sides[0]) and len(sides[1]):
        frontier, sides[0] = [(0, sides[0][0])], sides[0][1:]
        while frontier:
            side, one = frontier.pop()
            hit = _linked(one, sides[1 - side], start)
            if len(hit):
                out += [(one, x) for x in sides[1 - side][hit]]
                frontier += [(1 - side, x) for x in sides[1 - side][hit]]
                sides[1 - side] = np.delete(sides[1 - side], hit)
    return out


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for start, left, right in zip(batch["start"], batch["left"], batch["right"]):
            left = np.asarray(left, dtype=np.int64).view(np.uint64)
            right = None if right is None else np.asarray(right, dtype=np.int64).view(np.uint64)
            out += _forest(left, right, int(start))
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span every
    component of the graph of all pairs at most MAX_BITS apart."""
    masks = [(i // 2, m) for i, m in enumerate(_first_masks())]
    by = ["start", "mask", "value"]
    none = F.lit(None).cast("array<long>")

    def sized(keys: DataFrame) -> DataFrame:
        return write_table(keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "block-sizes")[0]

    def whole(keys: DataFrame, sizes: DataFrame) -> DataFrame:
        small = keys.join(sizes.where(F.col("n") <= block), by)
        return small.groupBy(*by).agg(F.collect_list("fp").alias("left")).select("start", "left", none.alias("right"))

    keys = _keys(fps, masks)
    sizes = sized(keys)
    blocks = whole(keys, sizes)
    large = sizes.where(F.col("n") > block)
    if not large.isEmpty():
        # their masks, divided by the bits that are still free
        finer = F.create_map(*[x for _, m in masks for x in (
            F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in _finer(m)]))])
        keys = (keys.join(large.drop("n"), by).select("start", F.explode(finer[F.col("mask")]).alias("mask"), "fp")
                .select("start", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp"))
        sizes = sized(keys)
        tiled = (keys.join(sizes.where(F.col("n") > block), by)
                 .withColumn("tiles", F.ceil(F.col("n") / block).cast("int"))
                 .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")))
        met = (tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
               .groupBy(*by, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
               .agg(F.collect_list(F.when(F.col("tile") <= F.col("other"), F.col("fp"))).alias("left"),
                    F.collect_list(F.when(F.col("tile") > F.col("other"), F.col("fp"))).alias("right")))
        blocks = blocks.unionByName(whole(keys, sizes)).unionByName(
            met.select("start", "left", F.when(F.col("i") < F.col("j"), F.col("right")).alias("right")))
    return blocks.mapInPandas(_spans, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(id, fingerprint, component_id), a row for each row of ``docs``.

    ``fingerprint`` has 16 hex digits. ``component_id`` is the smallest id reachable
    over fingerprints at most three bits apart. Texts that are null, empty or blank
    have fingerprint zero and link like any other; repeated rows each get a row; a
    null id never names a component (null if its whole component has none).
    """
    prints, _ = write_table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct, _ = write_table(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    parts, _ = write_table(connected_components(links(distinct.select("fp"), block)), "fingerprint-parts")
    named = (distinct.join(parts, distinct["fp"] == parts["node"], "left")
             .select("fp", "least", F.coalesce("component", "fp").alias("part")))
    smallest = named.groupBy("part").agg(F.min("least").alias("component_id")).withColumnRenamed("part", "p")
    classes = (named.join(smallest, F.bitwise_not("part") == F.bitwise_not("p"))
               .select(F.col("fp").alias("k"), "component_id"))
    return (prints.join(classes, F.bitwise_not("fp") == F.bitwise_not("k"))
            .select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
