"""User-supplied logic: column transforms, filter actions, summary methods and
external mapper programs.

User functions are ``Column -> Column`` (stay in codegen) or ``DataFrame ->
DataFrame`` (compose into the plan). Python code that cannot be expressed that
way runs per Arrow batch through ``mapInPandas`` (see ``operators.jobs``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnFn = Callable[[Column], Column]
FrameFn = Callable[[DataFrame], DataFrame]


def chain(*fns: ColumnFn) -> ColumnFn:
    """Apply column functions in order (a column's filter chain)."""
    def run(c: Column) -> Column:
        for f in fns:
            c = f(c)
        return c
    return run


def apply_filter_action(df: DataFrame, actions: Mapping[str, FrameFn], table_type: str) -> DataFrame:
    """Run the filter method registered for a table (or row) type; a missing
    method is an error, as for an action without its filter function."""
    try:
        fn = actions[table_type]
    except KeyError:
        raise NotImplementedError(f"no filter method for type {table_type!r}") from None
    return df.transform(fn)


def external_program(df: DataFrame, mapper: Callable[[pd.DataFrame], pd.DataFrame], out_schema: str,
                     key: str, value: str, reduce: str = "sum") -> DataFrame:
    """A user mapper/reducer job: see :func:`cirrus.operators.jobs.map_reduce`."""
    from cirrus.operators.jobs import map_reduce
    return map_reduce(df, mapper, out_schema, key, value, reduce)


def run_text_program(spark, input_path: str, output_path: str, mapper: Callable[..., pd.DataFrame],
                     out_schema: str, key: str, value: str, reduce: str = "sum", args: Mapping | None = None,
                     out_format: str = "parquet") -> DataFrame:
    """A user program over a folder of text: every line (column ``value``) goes
    through ``mapper(batch, **args)``, the associative reducer runs as a
    combiner and per key, the result is written to ``output_path`` and read
    back from there."""
    from functools import partial
    lines = spark.read.option("lineSep", "\n").text(input_path)
    result = external_program(lines, partial(mapper, **dict(args or {})), out_schema, key, value, reduce)
    result.write.mode("overwrite").format(out_format).save(output_path)
    return spark.read.format(out_format).load(output_path)


def initial_mapper(batch: pd.DataFrame, min_length: int = 0) -> pd.DataFrame:
    """Example mapper: (lower-cased first character, 1) for lines of at least
    ``min_length`` characters."""
    lines = batch["value"].fillna("")
    lines = lines[lines.str.len() >= min_length]
    return pd.DataFrame({"key": lines.str[:1].str.lower().values, "n_lines": 1})
