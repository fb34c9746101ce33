"""Centroid clustering in integers, by Shallot search.

Vectors become integers and travel in blocks, with a state for each vector: its
centroid, its second-nearest one, an upper bound of the distance to the first and a
lower bound of the distance to all others. A round moves the bounds by what the
centroids moved; a vector whose bounds still separate is not looked at. Any other
one starts from the closer of its two remembered centroids and scans that one's
neighbours by distance, inside a ball that shrinks with the second-best distance
found so far. Distances that decide are compared as integers, so ties are exact.

A round is one job that writes the blocks with their new state and sums; the table
before is dropped. Only sums (centroids x components) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.llm.storage import drop_table, write_table

#: Vectors of a block.
BLOCK_ROWS = 4096
#: Components from 2**28 on could make a squared distance that no long holds.
MOST = 1 << 28
#: Slack for rounding, so that bounds in floating point stay bounds.
_SLACK = 1e-9

_STATE = np.dtype([("near", "<i4"), ("second", "<i4"), ("upper", "<f8"), ("lower", "<f8")])
_BLOCKS = "ids array<bigint>, vectors binary, state binary, sums binary"


def quantise(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their components as integers). Kept are vectors of ``dims``
    components, all finite; a kept component of 2**28 or more is an error."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    kept = sizes == dims
    if not kept.any():
        return kept, np.empty((0, dims), dtype=np.int64)
    flat = pc.list_flatten(column.filter(pa.array(kept))).cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)
    kept[np.flatnonzero(kept)[~finite]] = False
    values = np.floor(scale * values[finite])
    if values.size and np.abs(values).max() >= MOST:
        raise ValueError(f"a component times {scale} is {MOST} or more: squared distances would not fit a long")
    return kept, values.astype(np.int64)


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of points to one centre, or each to its own."""
    gap = points - centre
    return np.einsum("ij,ij->i", gap, gap)


class Centres:
    """Centroids of a round, their distances and how far each has moved."""

    def __init__(self, centres: np.ndarray, earlier: np.ndarray | None):
        self.points = centres
        k = len(centres)
        gaps = np.sqrt(np.array([squared(centres, c) for c in centres], dtype=np.float64)).reshape(k, k)
        np.fill_diagonal(gaps, -1.0)                    # a centroid comes first among its own neighbours
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        self.half = self.gaps[:, 1] / 2 * (1 - _SLACK) if k > 1 else np.full(k, np.inf)
        if earlier is not None:
            self.moved = np.sqrt(squared(centres, earlier).astype(np.float64)) * (1 + _SLACK)
            most = int(self.moved.argmax())
            self.others = np.full(k, self.moved[most])  # the farthest move among the other centroids
            self.others[most] = np.delete(self.moved, most).max() if k > 1 else 0.0


def assign(points: np.ndarray, centres: Centres, state: np.ndarray | None) -> tuple[np.ndarray, int]:
    """(the state after this round, number of distances computed). ``near`` is the
    nearest centroid, the smaller number if two are equally near."""
    n, k = len(points), len(centres.points)
    computed = 0
    if state is None:
        state = np.zeros(n, dtype=_STATE)
        state["second"] = min(1, k - 1)
        state["upper"] = np.inf
    else:
        state = state.copy()
        state["upper"] += centres.moved[state["near"]]
        state["lower"] -= centres.others[state["near"]]
    if k == 1:
        return state, 0
    bound = np.maximum(state["lower"], centres.half[state["near"]])
    rows = np.flatnonzero(~(state["upper"] < bound))
    if not len(rows):
        return state, 0
    at = points[rows]
    near, second = state["near"][rows], state["second"][rows]
    d_near = squared(at, centres.points[near])
    computed += len(rows)
    upper = np.sqrt(d_near.astype(np.float64)) * (1 + _SLACK)
    state["upper"][rows] = upper
    left = ~(upper < bound[rows])
    rows, at, near, second, d_near = rows[left], at[left], near[left], second[left], d_near[left]
    if not len(rows):
        return state, computed
    d_second = squared(at, centres.points[second])
    computed += len(rows)
    known = np.stack([near, second])
    swap = (d_second < d_near) | ((d_second == d_near) & (second < near))
    near, second = np.where(swap, second, near), np.where(swap, near, second)
    d_near, d_second = np.where(swap, d_second, d_near), np.where(swap, d_near, d_second)
    start, reach = near.copy(), np.sqrt(d_near.astype(np.float64))
    active = np.arange(len(rows))
    for step in range(1, k):
        ball = (reach[active] + np.sqrt(d_second[active].astype(np.float64))) * (1 + _SLACK)
        active = active[centres.gaps[start[active], step] <= ball]
        if not len(active):
            break
        other = centres.order[start[active], step]
        fresh = (other != known[0, active]) & (other != known[1, active])
        some, other = active[fresh], other[fresh]
        if not len(some):
            continue
        d = squared(at[some], centres.points[other])
        computed += len(some)
        first = (d < d_near[some]) | ((d == d_near[some]) & (other < near[some]))
        then = ~first & (d < d_second[some])
        second[some] = np.where(first, near[some], np.where(then, other, second[some]))
        d_second[some] = np.where(first, d_near[some], np.where(then, d, d_second[some]))
        near[some], d_near[some] = np.where(first, other, near[some]), np.where(first, d, d_near[some])
    state["near"][rows], state["second"][rows] = near, second
    state["upper"][rows] = np.sqrt(d_near.astype(np.float64)) * (1 + _SLACK)
    state["lower"][rows] = np.sqrt(d_second.astype(np.float64)) * (1 - _SLACK)
    return state, computed


def _batch(ids, vectors, state, sums) -> pa.RecordBatch:
    return pa.record_batch([pa.array([ids], pa.list_(pa.int64())), pa.array([vectors], pa.binary()), pa.array([state], pa.binary()),
                            pa.array([sums], pa.binary())], names=["ids", "vectors", "state", "sums"])


def _pack(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """The kept vectors in blocks, without a state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                kept, points = quantise(part.column(1), dims, scale)
                if len(points):
                    ids = part.column(0).filter(pa.array(kept)).to_pylist()
                    yield _batch(ids, points.astype("<i4").tobytes(), None, None)
    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(run, _BLOCKS)


def _starts(blocks: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The vectors with the ``k`` smallest hashed ids; every block offers its own."""
    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                points = np.frombuffer(packed, dtype="<i4").reshape(len(ids), dims)
                keys = [hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in ids if i is not None]
                rows = sorted(zip(keys, (r.tobytes() for i, r in zip(ids, points) if i is not None)))[:k]
                yield pa.record_batch([pa.array([key for key, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.binary())],
                                      names=["key", "vector"])
    found = blocks.select("ids", "vectors").mapInArrow(offer, "key string, vector binary").orderBy("key", "vector").limit(k).collect()
    return np.array([np.frombuffer(r["vector"], dtype="<i4") for r in found], dtype=np.int64).reshape(-1, dims)


def _assigned(blocks: DataFrame, dims: int, centres: np.ndarray, earlier: np.ndarray | None) -> DataFrame:
    """Blocks with the state of this round and its sums: for each centroid the number
    of its vectors, then their componentwise sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centres(centres, earlier)
        for batch in batches:
            for row in batch.to_pylist():
                points = np.frombuffer(row["vectors"], dtype="<i4").reshape(-1, dims).astype(np.int64)
                state = None if row["state"] is None else np.frombuffer(row["state"], dtype=_STATE)
                state, _ = assign(points, now, state)
                sums = np.zeros((len(centres), dims + 1), dtype="<i8")
                for c in np.unique(state["near"]):
                    mine = points[state["near"] == c]
                    sums[c, 0], sums[c, 1:] = len(mine), mine.sum(axis=0)
                yield _batch(row["ids"], row["vectors"], state.tobytes(), sums.tobytes())
    return blocks.mapInArrow(run, _BLOCKS)


def _moved(blocks: DataFrame, dims: int, centres: np.ndarray) -> np.ndarray:
    """The next centroids: floor of sum by count; one without vectors stays."""
    k, width = len(centres), dims + 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * width, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.frombuffer(packed, dtype="<i8")
        yield pa.record_batch([pa.array(np.arange(k * width), pa.int64()), pa.array(total, pa.int64())], names=["place", "value"])
    found = (blocks.select("sums").mapInArrow(fold, "place bigint, value bigint").groupBy("place")
             .agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect())
    sums = {r["place"]: int(r["value"]) for r in found}
    after = centres.copy()
    for c in range(k):
        if count := sums[c * width]:
            after[c] = [sums[c * width + 1 + i] // count for i in range(dims)]
    return after


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 8,
            rounds: int = 10, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), centroids). Vectors that are null, have other than
    ``dims`` components or a null or non-finite one are left out. The first centroids
    are the vectors with the ``k`` smallest sha256 of ``seed:id`` (equal ids: the lesser
    vector first; vectors without an id start none but are assigned); fewer than ``k`` vectors make fewer centroids, and
    none (an empty table) an empty result. Repeated rows are rows of their own; other columns are ignored."""
    blocks, path = write_table(_pack(vectors, id_col, vec_col, dims, scale), "centroid-blocks")
    centres, earlier = _starts(blocks, k, dims, seed), None
    if not len(centres):
        empty = blocks.select(F.lit(0).cast("long").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty.where("false"), centres
    for _ in range(rounds):
        old = path
        blocks, path = write_table(_assigned(blocks, dims, centres, earlier), "centroid-blocks")
        drop_table(blocks.sparkSession, old)
        earlier, centres = centres, _moved(blocks, dims, centres)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centres(centres, earlier)
        for batch in batches:
            for row in batch.to_pylist():
                points = np.frombuffer(row["vectors"], dtype="<i4").reshape(-1, dims).astype(np.int64)
                state = None if row["state"] is None else np.frombuffer(row["state"], dtype=_STATE)
                near = assign(points, now, state)[0]["near"]
                yield pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(near, pa.int32()),
                                       pa.array(squared(points, centres[near]), pa.int64())], names=[id_col, "cluster", "distance"])
    done, _ = write_table(blocks.select("ids", "vectors", "state").mapInArrow(finish, f"`{id_col}` bigint, cluster int, distance bigint"),
                          "centroid-result")
    drop_table(blocks.sparkSession, path)
    return done, centres


def with_inertia(assigned: DataFrame, centres: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256 of its cluster. The
    list of clusters has a row for each centroid, so it is sent to every task."""
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] for r in per)
    rows = [(r["cluster"], r["cluster_inertia"], total,
             hashlib.sha256(",".join(map(str, centres[r["cluster"]].tolist())).encode()).hexdigest()) for r in per]
    notes = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(notes), "cluster").select(
        *assigned.columns, "cluster_inertia", "inertia", "centroid_sha256")
