"""Status logic as three-valued boolean Columns (True / None / False)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): default status choices of a status column.
DEFAULT_STATUS_CHOICES = (
    ("enabled", True), ("true", True), ("up", True), ("yes", True), ("active", True), ("on", True),
    ("none", None), ("unknown", None), ("", None),
    ("disabled", False), ("down", False), ("false", False), ("inactive", False), ("no", False), ("off", False),
)


def status_of_value(c: Column, choices: Sequence[tuple[str, bool | None]] = DEFAULT_STATUS_CHOICES) -> Column:
    """First choice equal to the value ignoring case gives its status; no match -> None.
    A null cell is compared as the text 'none'."""
    txt = F.lower(F.coalesce(c.cast("string"), F.lit("none")))
    expr = None
    for value, status in choices:
        cond = txt == F.lit(str(value).lower())
        v = F.lit(status).cast("boolean")
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr.otherwise(F.lit(None).cast("boolean"))


def row_status(*statuses: Column) -> Column:
    """Any False -> False, else any None -> None, else True: SQL's Kleene AND."""
    return reduce(lambda a, b: a & b, statuses)


def all_true(c: Column) -> Column:
    """Aggregate: every value true (``bool_and``)."""
    return F.bool_and(c)
