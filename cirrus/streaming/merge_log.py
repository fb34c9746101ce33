"""A log of rows that fold together, compacted in size tiers.

Every micro-batch adds a run (a folder of Parquet files). When ``fanout`` runs of one
tier exist they are folded into one run of the next, so that after n batches a reader
opens a number of runs logarithmic in n, and a row is rewritten a logarithmic number
of times. The manifest, a small file that names the live runs and the last batch, is
committed by a rename; it decides what exists. A crash between writing and the commit
leaves folders that nothing names, and the replayed batch writes them again; a
replay after the commit changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cirrus.session import dir_exists, filesystem, make_dir, remove_dir

Fold = Callable[[DataFrame], DataFrame]


class MergeLog:
    """``fold`` makes fewer rows of many, whatever their order and grouping; its result
    has its input's columns. One writer at a time (a stream); any number of readers."""

    def __init__(self, spark: SparkSession, path: str, schema, fold: Fold, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout must be 2 at least")
        self.spark, self.path, self.schema, self.fold, self.fanout = spark, path.rstrip("/"), schema, fold, fanout

    def _versions(self) -> list[int]:
        folder = f"{self.path}/manifest"
        if not dir_exists(self.spark, folder):
            return []
        fs, target = filesystem(self.spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        """The committed state: version, last batch, runs (folder, tier), and the runs
        that the last commit replaced."""
        versions = self._versions()
        if not versions:
            return {"version": -1, "batch": -1, "runs": [], "replaced": []}
        fs, target = filesystem(self.spark, f"{self.path}/manifest/{versions[-1]}.json")
        stream = fs.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        folder = make_dir(self.spark, f"{self.path}/manifest")
        fs, draft = filesystem(self.spark, f"{folder}/{uuid.uuid4().hex}.draft")
        stream = fs.create(draft)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        _, final = filesystem(self.spark, f"{folder}/{state['version']}.json")
        if not fs.rename(draft, final):
            raise RuntimeError(f"another writer committed version {state['version']} of {self.path}")

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{r}" for r in runs])

    def _write(self, rows: DataFrame) -> str:
        run = f"run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{run}")
        return run

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch, fold full tiers, commit, and delete what the commit
        before this one replaced (a reader of that state may have been at work)."""
        state = self.manifest()
        if batch_id <= state["batch"]:
            return
        runs = [*state["runs"], [self._write(self.fold(rows)), 0]]
        replaced = []
        while full := [t for t, n in Counter(t for _, t in runs).items() if n >= self.fanout]:
            tier = min(full)
            merged = [r for r, t in runs if t == tier]
            runs = [*[x for x in runs if x[1] != tier], [self._write(self.fold(self._read(merged))), tier + 1]]
            replaced += merged
        self._commit({"version": state["version"] + 1, "batch": batch_id, "runs": runs, "replaced": replaced})
        for run in state["replaced"]:
            remove_dir(self.spark, f"{self.path}/{run}")
        for version in self._versions()[:-2]:
            remove_dir(self.spark, f"{self.path}/manifest/{version}.json")

    def read(self) -> DataFrame:
        """The folded rows of all batches committed; none if there are none."""
        runs = [r for r, _ in self.manifest()["runs"]]
        return self.fold(self._read(runs)) if runs else self.spark.createDataFrame([], self.schema)
