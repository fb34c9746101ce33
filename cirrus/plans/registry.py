"""Query catalogue.

``@query(key, sql=...)`` registers a callable ``(spark, sf_dir) -> DataFrame`` and,
when given, the equivalent ANSI SQL the DuckDB oracle runs on the same tables.
Keys without SQL (generators, file sources, streams) get a rows-only check and
are compared with their batch twin in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cirrus.session import ensure_utc

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}
SECTIONS: dict[str, str] = {}


def query(key: str, sql: str | None = None, section: str = ""):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key!r}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        SECTIONS[key] = section
        if sql is not None:
            ORACLE_SQL[key] = sql.strip()
        return run

    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from cirrus.plans import (  # noqa: F401
        q_sources, q_filters, q_joins, q_aggregates, q_sorts, q_setops, q_time, q_scalar, q_graph,
        q_streams, q_udf,
    )
