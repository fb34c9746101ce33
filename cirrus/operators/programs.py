"""User reducers that need a key's values in order.

Rows are dealt over range partitions of (key, order) and sorted inside them, so a
partition holds whole stretches of ordered values and a key with a third of all rows
spans many partitions. A program folds the rows of a batch into a state per key, and
merges the states of adjoining stretches; values are streamed, never gathered. Only
keys that go over a partition's edge are merged afterwards, a state per partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.session import scratch_dir


class OrderedProgram:
    """A reducer over ordered values.

    ``state`` is the DDL of a state's columns. :meth:`fold` makes a state of each
    stretch, :meth:`merge` one of two that adjoin (both for many keys at once, row by
    row), :meth:`result` the output columns from a state's columns.
    """
    state: str

    def fold(self, rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """``rows`` in order, a stretch from each of ``starts`` to the next."""
        raise NotImplementedError

    def merge(self, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def result(self) -> list[Column]:
        raise NotImplementedError


def _same(a: pd.Series, b: pd.Series) -> bool:
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def reduce_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], program: OrderedProgram,
                   partitions: int | None = None) -> DataFrame:
    """(keys, results of ``program``), a row for each key, its rows read in ``order``.

    Null keys are keys like any other, null values of ``order`` come first. Ties in
    ``order`` are in no order: end it with a unique column where that matters."""
    keys, order = list(keys), list(order)
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    columns = [F.col(c) for c in [*keys, *order]]
    dealt = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    state_names = [f.split()[0] for f in program.state.split(",")]
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, first, open_ = TaskContext.get().partitionId(), True, None
        for rows in batches:
            if not len(rows):
                continue
            rows = rows.reset_index(drop=True)
            changed = np.ones(len(rows), dtype=bool)
            changed[1:] = False
            for k in keys:
                now, before = rows[k].iloc[1:].reset_index(drop=True), rows[k].iloc[:-1].reset_index(drop=True)
                changed[1:] |= ~((now == before).fillna(False).astype(bool) | (now.isna() & before.isna())).to_numpy()
            starts = np.flatnonzero(changed)
            states = pd.concat([rows.loc[starts, keys].reset_index(drop=True), program.fold(rows, starts).reset_index(drop=True)], axis=1)
            if open_ is not None:
                head = states.iloc[:1]
                if _same(open_[keys].iloc[0], head[keys].iloc[0]):
                    joined = program.merge(open_[state_names].reset_index(drop=True), head[state_names].reset_index(drop=True))
                    for c in state_names:
                        states[c] = pd.concat([joined[c], states[c].iloc[1:]], ignore_index=True)
                else:
                    states = pd.concat([open_, states], ignore_index=True)
            open_ = states.iloc[-1:].reset_index(drop=True)
            done = states.iloc[:-1]
            if len(done):
                yield done.assign(_part=part, _edge=[first, *[False] * (len(done) - 1)])
                first = False
        if open_ is not None:
            yield open_.assign(_part=part, _edge=True)

    def join(stretches: pd.DataFrame) -> pd.DataFrame:
        stretches = stretches.sort_values("_part", kind="stable").reset_index(drop=True)
        total = stretches[state_names].iloc[:1]
        for i in range(1, len(stretches)):
            total = program.merge(total.reset_index(drop=True), stretches[state_names].iloc[i:i + 1].reset_index(drop=True))
        return pd.concat([stretches[keys].iloc[:1], total.reset_index(drop=True)], axis=1)

    path = scratch_dir(spark, "ordered")
    partial = dealt.mapInPandas(run, f"{key_ddl}, {program.state}, _part int, _edge boolean")
    partial.write.parquet(path)
    partial = spark.read.schema(partial.schema).parquet(path)
    whole = partial.where(~F.col("_edge")).select(*keys, *state_names)
    edges = partial.where("_edge").groupBy(*keys).applyInPandas(join, f"{key_ddl}, {program.state}")
    return whole.unionByName(edges).select(*keys, *program.result())


class Gaps(OrderedProgram):
    """Gaps between a key's samples: how many samples, the longest gap, and how many
    sessions (a gap above ``idle_s`` seconds begins a new one) with the longest
    session. ``ts`` is a column of microseconds."""
    state = "n long, first long, last long, longest long, sessions long, head_end long, tail_start long, longest_session long"

    def __init__(self, ts: str, idle_s: int):
        self.ts, self.idle = ts, idle_s * 1_000_000

    def fold(self, rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        t = rows[self.ts].to_numpy(dtype=np.int64)
        ends = np.append(starts[1:], len(t))
        gap = np.diff(t, prepend=t[:1])
        gap[starts] = 0
        breaks = gap > self.idle
        begins = np.flatnonzero(breaks | np.isin(np.arange(len(t)), starts))     # every session
        lasts = np.append(begins[1:], len(t)) - 1
        key_of = np.searchsorted(starts, begins, "right") - 1
        first_of = np.searchsorted(key_of, np.arange(len(starts)))
        return pd.DataFrame({
            "n": ends - starts, "first": t[starts], "last": t[ends - 1], "longest": np.maximum.reduceat(gap, starts),
            "sessions": np.bincount(key_of, minlength=len(starts)), "head_end": t[lasts[first_of]],
            "tail_start": t[begins[np.append(first_of[1:], len(begins)) - 1]],
            "longest_session": np.maximum.reduceat(t[lasts] - t[begins], first_of)})

    def merge(self, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        gap = right["first"] - left["last"]
        one = gap <= self.idle      # the sessions at the seam are one
        bridge = (right["head_end"] - left["tail_start"]).where(one, 0)
        return pd.DataFrame({
            "n": left["n"] + right["n"], "first": left["first"], "last": right["last"],
            "longest": np.maximum(np.maximum(left["longest"], right["longest"]), gap),
            "sessions": left["sessions"] + right["sessions"] - one.astype("int64"),
            "head_end": right["head_end"].where(one & (left["sessions"] == 1), left["head_end"]),
            "tail_start": left["tail_start"].where(one & (right["sessions"] == 1), right["tail_start"]),
            "longest_session": np.maximum(np.maximum(left["longest_session"], right["longest_session"]), bridge)})

    def result(self) -> list[Column]:
        return [F.col("n").alias("samples"), F.timestamp_micros("first").cast("timestamp_ntz").alias("first_sample"),
                F.timestamp_micros("last").cast("timestamp_ntz").alias("last_sample"),
                F.col("longest").alias("longest_gap_us"), "sessions", F.col("longest_session").alias("longest_session_us")]
