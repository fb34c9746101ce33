"""Near-duplicate vectors by randomised-rotation binary codes (RaBitQ).

A unit vector is turned by seeded random rotations. Its code is the signs of the turned
coordinates, with a correction factor a rotation, the inner product of the vector and
its code. The inner product of a code and another vector, divided by the code's factor,
is an unbiased estimate of the two vectors' cosine, with an error of about
sqrt((1 - factor ** 2) / factor ** 2 / (d - 1)). The other vector takes part as a
query of four bits a coordinate, whose rounding adds to the error. The estimate of a
pair is the mean over its rotations and both directions.

1. Candidates are vectors of one label that agree in a band of code bits. Bits grow with
   the logarithm of the largest label's rows, so that chance buckets stay small at any
   size; bands grow with the bits, so that a pair at the threshold is missed in all of them
   with probability ``MISS``. A pair counts in the first band in which it agrees.
2. Only codes, factors and queries travel to the buckets. A row stays in a bucket if the
   upper confidence bound of some pair of it reaches the threshold; never pairs are written.
3. Vectors travel to the buckets where they stayed. Their cosines are computed
   exactly, in double precision, and only those make links.

Equal vectors are compared once. Large buckets are compared in pairs of tiles, so no task
holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from math import acos, ceil, log, log1p, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirrus.llm.components import connected_components
from cirrus.llm.storage import drop_table, write_table

THRESHOLD = 0.98
#: A pair at the threshold agrees in no band with this probability, a closer one less likely.
MISS = 3e-4
#: Band bits beyond log2 of the rows of the largest label: a row meets 1/16 others by chance.
SPARE_BITS = 4
#: Half-width of the confidence bound, in standard errors of the estimate.
CONFIDENCE = 4.0
TILE = 2048
#: Rows of a tile that are compared at a time.
STRIPE = 256
#: Largest absolute value of a query's coordinates (four bits).
LEVELS = 7
_SEED = 977


def shape(most: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, bands) for ``most`` rows of one label. A sign of two vectors at the
    threshold differs with probability arccos(threshold) / pi."""
    bits = min(62, ceil(log2(max(most, 2))) + SPARE_BITS)
    agree = (1 - acos(min(max(threshold, -1.0), 1.0)) / pi) ** bits
    return bits, max(1, ceil(log(miss) / log1p(-min(agree, 1 - 1e-12))))


@lru_cache(maxsize=256)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng((_SEED, dim, number)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def rotations(dim: int, bits: int, bands: int) -> int:
    """How many rotations give the signs of all bands."""
    return ceil(bits * bands / dim)


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; no square overflows or vanishes."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def encode(x: np.ndarray, bits: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signs as 0 and 1, factors, queries, steps) of unit rows: signs and factors of
    every rotation, the query of the first one as whole steps."""
    dim = x.shape[1]
    turned = [x @ rotation(dim, k).T for k in range(rotations(dim, bits, bands))]
    signs = np.concatenate([t >= 0 for t in turned], 1).astype(np.uint8)
    factors = np.stack([np.abs(t).sum(1) for t in turned], 1) / np.sqrt(dim)
    steps = np.abs(turned[0]).max(1) / LEVELS
    return signs, factors, np.rint(turned[0] / steps[:, None]).astype(np.int8), steps


def band_values(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    return signs[:, :bits * bands].reshape(-1, bands, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


@lru_cache(maxsize=64)
def _turns(dim: int, n: int) -> np.ndarray:
    """From the coordinates of the first rotation to those of the first ``n``, side by side."""
    return np.concatenate([rotation(dim, 0) @ rotation(dim, k).T for k in range(n)], 1)


def prepare(signs: np.ndarray, factors: np.ndarray, queries: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, ...]:
    """What :func:`encode` gave, in the form that :func:`one_way` compares: codes divided by
    their factors, queries turned by every rotation, and the rows' shares of the error."""
    dim, n = queries.shape[1], factors.shape[1]
    code = (signs * 2.0 - 1) * np.repeat(1 / (np.sqrt(dim) * n * factors), dim, axis=1)
    asked = (queries * steps[:, None]) @ _turns(dim, n)
    error = (np.maximum(0, 1 - factors ** 2) / factors ** 2 / max(1, dim - 1)).sum(1) / n ** 2
    # rounding errors of one query are shared by its rotations
    return code, asked, error, (1 / factors ** 2).mean(1), steps ** 2 / 12


def one_way(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosine, standard error) of each code of ``x`` with each query of ``y``."""
    return x[0] @ y[1].T, np.sqrt(x[2][:, None] + np.outer(x[3], y[4]))


def _encoded(bits: int, bands: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.list_value_length(batch.column("vector")).to_numpy()
        for dim in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == dim))
            raw = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(f"<f{width}")
            signs, factors, queries, steps = encode(units(raw), bits, bands)
            nibbles = (np.pad(queries, ((0, 0), (0, dim % 2))) + 8).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({
                "least": part.column("least"), "n": part.column("n"), "label": part.column("label"),
                "dim": pa.array([dim] * part.num_rows, pa.int32()), "raw": [r.tobytes() for r in raw],
                "code": [r.tobytes() for r in np.packbits(signs, axis=1)],
                "factors": [r.tobytes() for r in factors.astype("<f4")],
                "query": [r.tobytes() for r in (nibbles[:, ::2] << 4 | nibbles[:, 1::2])],
                "step": pa.array(steps.astype(np.float32)),
                "bands": pa.array(band_values(signs, bits, bands).tolist(), pa.list_(pa.int64()))})


def _packed(rows: pa.StructArray, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows.field(name).to_pylist()), dtype=dtype).reshape(len(rows), -1)


def _codes(bits: int, bands: int, rows: pa.StructArray, dim: int) -> tuple[np.ndarray, ...]:
    """(ids, band values, prepared codes) of rows."""
    signs = np.unpackbits(_packed(rows, "code", "u1"), axis=1, count=dim * rotations(dim, bits, bands))
    nibbles = _packed(rows, "query", "u1")
    query = np.stack([nibbles >> 4, nibbles & 15], 2).reshape(len(rows), -1)[:, :dim].astype(np.int8) - 8
    return (rows.field("least").to_numpy(), band_values(signs, bits, bands),
            *prepare(signs, _packed(rows, "factors", "<f4").astype(np.float64), query, rows.field("step").to_numpy().astype(np.float64)))


def _vectors(bits: int, bands: int, width: int, rows: pa.StructArray, dim: int) -> tuple[np.ndarray, ...]:
    """(ids, band values, copies, unit vectors) of rows."""
    x = units(_packed(rows, "raw", f"<f{width}"))
    return rows.field("least").to_numpy(), band_values(encode(x, bits, bands)[0], bits, bands), rows.field("n").to_numpy(), x


def _buckets(batch: pa.RecordBatch, read):
    """(place in the batch, band, rows, others or None) of each bucket or pair of tiles; small
    buckets that follow each other are read together."""
    dims, band = batch.column("dim").to_numpy(), batch.column("band").to_numpy()
    left, right = (pc.list_value_length(batch.column(c)).to_numpy() for c in ("rows", "others"))
    start = 0
    while start < len(dims):
        stop, total = start + 1, left[start] + right[start]
        while stop < len(dims) and dims[stop] == dims[start] and total + left[stop] + right[stop] <= TILE:
            total += left[stop] + right[stop]
            stop += 1
        part = batch.slice(start, stop - start)
        rows, others = part.column("rows").flatten(), part.column("others").flatten()
        x, y = read(rows, int(dims[start])), read(others, int(dims[start])) if len(others) else None
        i = j = 0
        for at in range(start, stop):
            mine = tuple(v[i:i + left[at]] for v in x)
            yield at, int(band[at]), mine, tuple(v[j:j + right[at]] for v in y) if right[at] else None
            i, j = i + left[at], j + right[at]
        start = stop


def _first(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Which pairs agree in ``band`` and in none before it."""
    new = a[:, None, band] == b[None, :, band]
    for k in range(band):
        new &= a[:, None, k] != b[None, :, k]
    return new


def _staying(bits: int, bands: int, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket of which some pair may reach the threshold."""
    for batch in batches:
        places, ids = [], []
        for at, band, x, others in _buckets(batch, partial(_codes, bits, bands)):
            y = others or x
            left, right = np.zeros(len(x[0]), dtype=bool), np.zeros(len(y[0]), dtype=bool)
            for start in range(0, len(left), STRIPE):
                s = tuple(v[start:start + STRIPE] for v in x)
                there, error = one_way(s[2:], y[2:])
                back, error_back = one_way(y[2:], s[2:])
                likely = (there + back.T) / 2 + CONFIDENCE * (error + error_back.T) / 2 >= threshold
                if others is None:
                    likely = np.triu(likely, start + 1)
                if likely.any():
                    likely &= _first(s[1], y[1], band)
                left[start:start + STRIPE] |= likely.any(1)
                right |= likely.any(0)
            stay = [x[0][left | right]] if others is None else [x[0][left], y[0][right]]
            ids += stay
            places += [np.full(len(part), at) for part in stay]
        if places:
            key = batch.select(["key", "band", "label", "dim"]).take(pa.array(np.concatenate(places)))
            yield pa.RecordBatch.from_arrays([*key.columns, pa.array(np.concatenate(ids))], names=[*key.schema.names, "least"])


def _linked(bits: int, bands: int, width: int, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vector, links, other) by exact cosines: counts, and spanning pairs where
    other is not null."""
    for batch in batches:
        for _, band, x, others in _buckets(batch, partial(_vectors, bits, bands, width)):
            y = others or x
            shift = 0 if others is None else len(x[0])
            left, right, found = np.zeros(len(x[0]), np.int64), np.zeros(len(y[0]), np.int64), []
            for start in range(0, len(left), STRIPE):
                s = slice(start, start + STRIPE)
                # the product finds pairs near the threshold, the sum of each decides
                near = (x[3][s] @ y[3].T >= threshold - 1e-9) & _first(x[1][s], y[1], band)
                i, j = np.nonzero(np.triu(near, start + 1) if others is None else near)
                i += start
                ok = np.concatenate([np.einsum("ij,ij->i", x[3][i[p:p + 50_000]], y[3][j[p:p + 50_000]]) >= threshold
                                     for p in range(0, len(i), 50_000)] or [np.zeros(0, dtype=bool)])
                i, j = i[ok], j[ok]
                left += np.bincount(i, y[2][j], len(left)).astype(np.int64)
                right += np.bincount(j, x[2][i], len(right)).astype(np.int64)
                found.append(_forest(i, j + shift, shift + len(right)))
            everyone = x[0] if others is None else np.concatenate([x[0], y[0]])
            links = left + right if others is None else np.concatenate([left, right])
            pairs, some = _forest(*np.concatenate(found, 1), len(everyone)), np.nonzero(links)[0]
            if len(some):
                yield pa.RecordBatch.from_pydict({
                    "vector": pa.array(np.concatenate([everyone[some], everyone[pairs[0]]])),
                    "links": pa.array(np.concatenate([links[some], np.zeros(pairs.shape[1], np.int64)])),
                    "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(everyone[pairs[1]])])})


def _forest(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """At most ``size`` pairs with the same components: each row with the least of its own."""
    name = np.arange(size)
    while len(i):
        before = name.copy()
        least = np.minimum(name[i], name[j])
        np.minimum.at(name, name[i], least)
        np.minimum.at(name, name[j], least)
        name = name[name]
        if (name == before).all() and (name[i] == name[j]).all():
            break
    moved = np.nonzero(name != np.arange(size))[0]
    return np.stack([moved, name[moved]])


def _meet(rows: DataFrame, by: list[str], row: list[str], tile: int) -> DataFrame:
    """(by, rows, others) of the buckets of two rows or more, which have a column size;
    those above ``tile`` rows as pairs of tiles."""
    packed, keys = F.struct(*row), [F.col(c) for c in by]
    small = (rows.where((F.col("size") > 1) & (F.col("size") <= tile)).groupBy(*keys)
             .agg(F.collect_list(packed).alias("rows")))
    small = small.select(*by, "rows", F.slice("rows", 1, 0).alias("others"))
    tiled = (rows.where(F.col("size") > tile).withColumn("tiles", F.ceil(F.col("size") / tile).cast("int"))
             .withColumn("tile", F.pmod(F.xxhash64("least"), F.col("tiles")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))))
    large = (tiled.groupBy(*keys, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
             .agg(F.collect_list(F.when(F.col("tile") <= F.col("other"), packed)).alias("rows"),
                  F.collect_list(F.when(F.col("tile") > F.col("other"), packed)).alias("others"))
             .where((F.size("rows") > 0) & ((F.col("i") == F.col("j")) | (F.size("others") > 0))))
    return small.unionByName(large.select(*by, "rows", "others"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE,
                    miss: float = MISS) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of ``vectors``.

    Vectors link if their labels are equal (and not null), they have as many
    components and their cosine is at least ``threshold``. Vectors that are null, empty
    or zero or have a component that is null or not finite link with nothing, nor do
    rows with a null id (their component is null, they are not kept). Repeated rows
    are vectors of their own that link with each other.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vector_col).alias("vector"))
    usable = rows.where("id is not null and label is not null and size(vector) > 0 and not exists(vector, "
                        "x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(vector, x -> x <> 0)")
    groups, _ = write_table(usable.groupBy("label", "vector").agg(F.min("id").alias("least"),
                                                                  F.count(F.lit(1)).alias("n")), "distinct-vectors")
    most = groups.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, bands = shape(most, threshold, miss)
    # components travel as they came: four bytes for floats, eight for doubles
    width = 4 if isinstance(rows.schema["vector"].dataType.elementType, T.FloatType) else 8
    coded, codes_path = write_table(groups.mapInArrow(
        lambda batches: _encoded(bits, bands, width, batches), "least long, n long, label long, dim int, raw binary, code binary, "
        "factors binary, query binary, step float, bands array<long>"), "codes")
    # who meets whom is settled by hashed keys; codes go only where a row is not alone
    light = (coded.select("least", "label", "dim", F.posexplode("bands").alias("band", "value"))
             .select("least", "band", F.xxhash64("label", "dim", "band", "value").alias("key")))
    sizes = light.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    by, code = ["key", "band", "label", "dim"], ["least", "code", "factors", "query", "step"]
    met = light.join(sizes, "key").join(coded.select("label", "dim", *code), "least")
    staying, staying_path = write_table(_meet(met, by, code, tile).mapInArrow(
        lambda batches: _staying(bits, bands, threshold, batches), "key long, band int, label long, dim int, least long")
        .distinct(), "staying")
    left = staying.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    again = staying.join(left, by).join(coded.select("least", "n", "raw"), "least")
    found, _ = write_table(_meet(again, by, ["least", "n", "raw"], tile).mapInArrow(
        lambda batches: _linked(bits, bands, width, threshold, batches), "vector long, links long, other long"), "vector-links")
    drop_table(spark, staying_path)
    drop_table(spark, codes_path)
    counts = found.groupBy("vector").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null"), "vector", "other")
    judged = (groups.join(counts, groups["least"] == counts["vector"], "left").drop(counts["vector"])
              .join(parts, F.col("least") == F.col("node"), "left")
              .select(F.col("label").alias("_label"), groups["vector"].alias("_vector"),
                      (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                      F.coalesce("component", "least").alias("component_id")))
    usable_id = F.when(F.col("id").isNotNull(), F.col("label"))
    joined = rows.join(judged, (usable_id == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
