"""Named aggregate registry and small grouped aggregates.

Every aggregate here is a declarative Spark aggregate function, so the physical
plan is a partial (map-side) hash aggregate, a shuffle of the partial rows, and
a final aggregate: a hot group costs one partial row per map task, not a task
holding the whole group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SummaryFn = Callable[[Column], Column]

#: name -> aggregate expression. 'sum' and 'average' are the built-in summation
#: methods; register more with :func:`register_summary`.
SUMMATION_METHODS: dict[str, SummaryFn] = {
    "sum": F.sum,
    "average": F.avg,
    # money-style columns (two decimals) summed as exact cents: the result does
    # not depend on the order in which partial sums meet
    "sum_exact": lambda c: F.sum(c.cast("decimal(18,2)")).cast("double"),
    "average_exact": lambda c: F.sum(c.cast("decimal(18,2)")).cast("double") / F.count(c),
}


def register_summary(name: str, fn: SummaryFn) -> None:
    SUMMATION_METHODS[name] = fn


def summary_expr(method: str, c: Column) -> Column:
    try:
        fn = SUMMATION_METHODS[method]
    except KeyError:
        raise ValueError(f"Summation method {method!r} must be one of {sorted(SUMMATION_METHODS)}") from None
    return fn(c)
