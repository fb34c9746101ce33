"""Rows that turn Terminated when their id stops reporting.

Every id has a state (its newest row) and a timer at the time of that row plus the
silence allowed. New rows move the timer; when event time passes it, the id's row is
emitted again as not live. An id that returns is live again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cirrus.session import scratch_dir
from cirrus.streaming.jobs import run_available_now
from cirrus.streaming.merge_log import MergeLog


def live_changes(stream: DataFrame, key: str, ts: str, tie: str, cols: Sequence[str], silent_s: int,
                 late: str = "0 seconds") -> DataFrame:
    """(key, cols, live): a row whenever the newest row of an id changes, by (``ts``,
    ``tie``), and one with ``live`` false when the id has been silent for more than
    ``silent_s`` seconds of event time (in milliseconds). Rows that come more than
    ``late`` after the newest time of earlier batches are not looked at, as for any
    watermark. Rows without a key or a time are left out."""
    cols = list(cols)
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    texts = [f"c{i}" for i in range(len(cols))]
    rows = (stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
            .select(F.col(key).alias("k"), F.col(ts).cast("timestamp").alias("t"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
                    F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("tie"),
                    *[F.col(c).cast("string").alias(n) for c, n in zip(cols, texts)]).withWatermark("t", late))
    state_ddl = ", ".join(["us long", "tie long", "live boolean", *[f"{n} string" for n in texts]])

    def track(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.update((*old[:2], False, *old[3:]))
            yield pd.DataFrame([[k[0], *old[3:], False]], columns=["k", *texts, "live"])
            return
        best = old and (old[0], old[1])
        row = list(old[3:]) if old else None
        for pdf in batches:
            last = pdf.sort_values(["us", "tie"]).iloc[-1]
            if best is None or (last["us"], last["tie"]) > best:
                best, row = (int(last["us"]), int(last["tie"])), [None if pd.isna(last[n]) else last[n] for n in texts]
        timer = best[0] // 1000 + silent_s * 1000
        live = timer > state.getCurrentWatermarkMs()
        state.update((*best, live, *row))
        if live:
            state.setTimeoutTimestamp(timer)
        if old is None or best != tuple(old[:2]) or live != old[2]:
            yield pd.DataFrame([[k[0], *row, live]], columns=["k", *texts, "live"])

    out = rows.groupBy("k").applyInPandasWithState(
        track, f"k {types[key]}, {', '.join(f'{n} string' for n in texts)}, live boolean", state_ddl, "update",
        GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("k").alias(key), *[F.col(n).cast(types[c]).alias(c) for c, n in zip(cols, texts)], "live")


def keep_live(spark: SparkSession, stream: DataFrame, key: str, ts: str, tie: str, cols: Sequence[str], silent_s: int,
              late: str = "0 seconds", checkpoint: str | None = None, log_dir: str | None = None) -> DataFrame:
    """The current table of :func:`live_changes`, available-now: (key, cols, live). With
    the folders of an earlier run it goes on where that one stopped."""
    changes = live_changes(stream, key, ts, tie, cols, silent_s, late)

    def newest(rows: DataFrame) -> DataFrame:
        held = [c for c in rows.columns if c not in (key, "_batch")]
        return (rows.groupBy(key).agg(F.max_by(F.struct(*held), "_batch").alias("_row"), F.max("_batch").alias("_batch"))
                .select(key, "_row.*", "_batch"))

    log = MergeLog(spark, log_dir or scratch_dir(spark, "live_log"), T.StructType([*changes.schema.fields, T.StructField("_batch", T.LongType())]), newest)
    run_available_now(changes, lambda rows, i: log.append(rows.withColumn("_batch", F.lit(i).cast("long")), i),
                      checkpoint or scratch_dir(spark, "live_ckpt"), output_mode="update")
    return log.read().drop("_batch")
