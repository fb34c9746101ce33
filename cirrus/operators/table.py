"""Declarative table layer: projection, derived columns, filters, summary row, paging.

A ``TableSpec`` is compiled into one lazy DataFrame plan (select -> filter ->
display expressions); Catalyst prunes the scan to the declared columns and
pushes the filters into it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnSource = str | Column | Callable[[DataFrame], Column]


@dataclass
class ColumnSpec:
    """One table column: where its value comes from and how it is displayed."""
    name: str
    source: ColumnSource | None = None          # attribute name, Column, or df -> Column
    map_key: tuple[str, str] | None = None      # (map column, key): dict-style access
    filters: Sequence[Callable[[Column], Column]] = ()
    empty_value: str | None = None

    def expr(self, df: DataFrame) -> Column:
        if self.map_key is not None:
            m, k = self.map_key
            raw = F.col(m)[k]
        elif self.source is None:
            raw = F.col(self.name) if self.name in df.columns else F.lit(None).cast("string")
        elif isinstance(self.source, str):
            raw = F.col(self.source) if self.source in df.columns else F.lit(None).cast("string")
        elif isinstance(self.source, Column):
            raw = self.source
        else:
            raw = self.source(df)
        for f in self.filters:
            raw = f(raw)
        if self.empty_value is not None:
            raw = F.coalesce(raw.cast("string"), F.lit(self.empty_value))
        return raw


@dataclass
class TableSpec:
    """Declared columns; parent specs' columns come first (inheritance order)."""
    columns: Sequence[ColumnSpec]
    parents: Sequence["TableSpec"] = ()
    only: Sequence[str] | None = None           # Meta.columns: keep and order these

    def resolved(self) -> list[ColumnSpec]:
        seen: dict[str, ColumnSpec] = {}
        for p in self.parents:
            for c in p.resolved():
                seen[c.name] = c
        for c in self.columns:
            seen[c.name] = c
        cols = list(seen.values())
        if self.only is not None:
            by = {c.name: c for c in cols}
            cols = [by[n] for n in self.only if n in by]
        return cols

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[c.expr(df).alias(safe_name(c.name)) for c in self.resolved()])


def safe_name(name: str) -> str:
    """Keys holding ':' are renamed with '__' (e.g. 'ext:host' -> 'ext__host')."""
    return name.replace(":", "__")


def project_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep, drop and reorder by a declared column list; ':' becomes '__'."""
    return df.select(*[F.col(f"`{c}`").alias(safe_name(c)) for c in columns])


# --- filters ----------------------------------------------------------------------------

def contains_ci(c: Column, q: str) -> Column:
    """Case-insensitive substring test; a null cell never matches."""
    return F.coalesce(F.lower(c).contains(q.lower()), F.lit(False))


def filter_contains(df: DataFrame, column: str, q: str) -> DataFrame:
    return df.where(contains_ci(F.col(column), q))


def filter_contains_any(df: DataFrame, columns: Sequence[str], q: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [contains_ci(F.col(c), q) for c in columns]))


def filter_regex_row(df: DataFrame, columns: Sequence[str], pattern: str) -> DataFrame:
    """Keep rows whose visible cell text (cells concatenated) matches a
    case-insensitive regular expression."""
    try:
        re.compile(pattern)
    except re.error as e:   # a user error, reported before any job runs
        raise ValueError(f"invalid filter pattern {pattern!r}: {e}") from None
    text = F.concat_ws("", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.where(text.rlike("(?i)" + pattern))


def escape_like(s: str, esc: str = "\\") -> str:
    return s.replace(esc, esc + esc).replace("%", esc + "%").replace("_", esc + "_")


def wildcard_like_pattern(filter_string: str) -> str:
    """LIKE pattern of an ordered, unanchored '*' wildcard. Only the first
    space-separated term of the lower-cased filter counts."""
    term = filter_string.lower().strip().split(" ")[0]
    parts = [p for p in term.split("*") if p != ""]
    return "%" + "%".join(escape_like(p) for p in parts) + "%" if parts else "%"


def filter_wildcard(df: DataFrame, column: str, filter_string: str) -> DataFrame:
    return df.where(F.lower(F.col(column)).like(wildcard_like_pattern(filter_string)))


OPS = {"eq": lambda c, v: c == v, "ge": lambda c, v: c >= v, "le": lambda c, v: c <= v,
       "gt": lambda c, v: c > v, "lt": lambda c, v: c < v, "ne": lambda c, v: c != v}


def query_predicate(conditions: Sequence[Mapping]) -> Column:
    """Conjunction of ``{field, op, value}`` conditions. Several ``eq`` on the
    same field are OR-ed (one id or a list of ids); fields are AND-ed."""
    by_field: dict[tuple[str, str], list] = {}
    for c in conditions:
        by_field.setdefault((c["field"], c.get("op", "eq")), []).append(c["value"])
    preds = []
    for (fld, op), values in by_field.items():
        col = F.col(fld)
        if op == "eq":
            preds.append(col.isin(values) if len(values) > 1 else col == F.lit(values[0]))
        else:
            preds.extend(OPS[op](col, F.lit(v)) for v in values)
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def id_conditions(singles: Mapping[str, object] | None = None,
                  lists: Mapping[str, Sequence] | None = None) -> list[dict]:
    """``eq`` conditions per field from a single id or a list of ids; a given
    single id has priority over the field's list."""
    singles, lists = dict(singles or {}), dict(lists or {})
    out = []
    for fld in list(dict.fromkeys([*singles, *lists])):
        ids = [singles[fld]] if singles.get(fld) else list(lists.get(fld) or [])
        out += [{"field": fld, "op": "eq", "value": v} for v in ids]
    return out


def range_conditions(field: str, lower=None, upper=None) -> list[dict]:
    """``ge``/``le`` bounds on a field; a missing bound adds no condition."""
    out = []
    if lower is not None:
        out.append({"field": field, "op": "ge", "value": lower})
    if upper is not None:
        out.append({"field": field, "op": "le", "value": upper})
    return out


def time_range_predicate(df: DataFrame, ts: str, lower=None, upper=None, day: str = "day") -> Column:
    """``lower <= ts <= upper``; when the table is laid out in ``day=YYYY-MM-DD``
    partitions, the same bounds on the partition column are added, so Spark
    prunes whole partitions (``PartitionFilters``) before reading any file."""
    preds = []
    lo = F.lit(lower).cast("timestamp_ntz") if lower is not None else None
    hi = F.lit(upper).cast("timestamp_ntz") if upper is not None else None
    if lo is not None:
        preds.append(F.col(ts) >= lo)
    if hi is not None:
        preds.append(F.col(ts) <= hi)
    if day in df.columns:
        if lo is not None:
            preds.append(F.col(day) >= F.to_date(lo))
        if hi is not None:
            preds.append(F.col(day) <= F.to_date(hi))
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def filter_query(df: DataFrame, conditions: Sequence[Mapping]) -> DataFrame:
    return df.where(query_predicate(conditions))


def filter_equal_attrs(df: DataFrame, **attrs) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in attrs.items()]))


def ownership_categories(is_public: Column, owner: Column, user_tenant: str,
                         filter_tenants: Sequence[str] = ()) -> Column:
    """Categories of a shared resource: 'public' when public; then 'project' when
    owned by the user's tenant, else the owner's id when it is one of the
    filter tenants, else 'shared' when not public. A public resource of another
    tenant is therefore only 'public'; one of the user's is both."""
    pub = F.coalesce(is_public, F.lit(False))
    own = (F.when(owner == F.lit(user_tenant), F.lit("project"))
           .when(owner.isin(list(filter_tenants)), owner) if filter_tenants
           else F.when(owner == F.lit(user_tenant), F.lit("project")))
    own = own.when(~pub, F.lit("shared"))
    return F.array_compact(F.array(F.when(pub, F.lit("public")), own))


def category_counts(df: DataFrame, categories: str, buttons: Sequence[str]) -> DataFrame:
    """Rows per category for a fixed list of buttons (zero when empty), from one
    aggregate over the exploded categories."""
    counts = df.select(F.explode(categories).alias("category")).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    btn = spark.createDataFrame([(b, i) for i, b in enumerate(buttons)], "category string, pos int")
    return btn.join(counts, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def filter_by_category(df: DataFrame, categories: str, value: str | None) -> DataFrame:
    """Rows whose category array holds ``value``; an empty value keeps every row."""
    return df if not value else df.where(F.array_contains(F.col(categories), value))


def filter_not_in_nullsafe(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Drop rows whose value is listed; null is kept (unlike SQL NOT IN)."""
    c = F.col(column)
    return df.where(c.isNull() | ~c.isin(list(values)))


def split_by(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where predicate, rows where not) over one plan."""
    return df.where(predicate), df.where(~predicate | predicate.isNull())


def lookup_unique(df: DataFrame, id_column: str, value: str) -> DataFrame:
    """The one row whose id (as text) equals ``value``. Raises LookupError when
    none matches and ValueError when several do (probe reads at most two rows)."""
    kind = df.schema[id_column].dataType
    # the literal takes the column's type, so the scan gets the filter; a text that is
    # not written as the column would write it ('042') matches nothing
    same = F.lit(str(value)).try_cast(kind)
    hit = df.where((F.col(id_column) == same) & (same.cast("string") == F.lit(str(value))))
    n = hit.limit(2).count()
    if n == 0:
        raise LookupError(f"no row with {id_column} = {value!r}")
    if n > 1:
        raise ValueError(f"multiple rows with {id_column} = {value!r}")
    return hit


def lookup_points(df: DataFrame, id_column: str, values: Sequence) -> DataFrame:
    """Rows of some ids, one for each id at most: a ValueError in the task if an id has
    several rows. The given values take the column's type, not the column theirs, so the
    look-up reaches the scan (text that is no such value, as an id, matches nothing).
    Absent ids have no row."""
    kind = df.schema[id_column].dataType
    if isinstance(kind, T.IntegralType):    # a null in the list would keep the scan from skipping anything
        whole = [int(v) for v in values if re.fullmatch(r"\s*[+-]?[0-9]+\s*", str(v))]
        values = [v for v in whole if v.bit_length() < 64]
    wanted = [F.lit(v).cast(kind) if not isinstance(kind, T.IntegralType) else F.lit(v) for v in values]
    found = df.where(F.col(id_column).isin(*wanted)) if wanted else df.limit(0)
    # few rows: those asked for
    n = F.count(F.lit(1)).over(Window.partitionBy(id_column))
    several = F.raise_error(F.concat(F.lit(f"several rows for {id_column} "), F.col(id_column).cast("string")))
    return found.withColumn("_n", n).where(F.when(F.col("_n") > 1, several.cast("boolean")).otherwise(True)).drop("_n")


def extract_named_keys(df: DataFrame, column: str, pattern: str, id_name: str = "key_id") -> DataFrame:
    """Keep keys matching ``pattern`` (group 1 = the id) and extract the id."""
    ext = F.regexp_extract(F.col(column), pattern, 1)
    return df.withColumn(id_name, ext).where(F.col(id_name) != "")


def compose_key(*parts: Column, sep: str = "__") -> Column:
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def split_key(key: Column, n: int = 3, sep: str = "__") -> Column:
    """Array of the parts when there are exactly ``n``, else null."""
    arr = F.split(key, re.escape(sep))
    return F.when(F.size(arr) == n, arr)


# --- summary row and paging --------------------------------------------------------------

def page_after_marker(df: DataFrame, key: str, marker, page_size: int, api_limit: int | None = None) -> DataFrame:
    """Keyset paging: rows with ``key > marker`` in key order. ``page_size + 1``
    rows are fetched (a top-k, never a full sort); the extra row only sets
    ``has_more``. ``next_marker`` is the last key of the page when there is more.
    The windows below run over those at most ``page_size + 1`` rows."""
    from pyspark.sql import Window
    fetched = df.where(F.col(key) > F.lit(marker)) if marker is not None else df
    fetched = fetched.orderBy(F.col(key)).limit(page_size + 1)
    allw = Window.partitionBy()
    ranked = (fetched.withColumn("_rn", F.row_number().over(Window.orderBy(F.col(key))))
              .withColumn("_n", F.count(F.lit(1)).over(allw)))
    page = ranked.where(F.col("_rn") <= page_size)
    has_more = F.col("_n") > page_size
    if api_limit is not None:   # a service that returned exactly its hard limit may have more
        has_more = has_more | (F.col("_n") == api_limit)
    return (page.withColumn("has_more", has_more)
                .withColumn("next_marker", F.when(has_more, F.max(F.col(key)).over(allw)))
                .drop("_rn", "_n"))


def page_around_marker(df: DataFrame, keys: Sequence[str], marker: Sequence | None, page_size: int,
                       backward: bool = False) -> DataFrame:
    """A page in the order of several ``keys`` (together unique, without nulls) after the
    row whose keys are ``marker``, or before it (``backward``; without a marker the last
    page), in key order both ways. ``has_more`` tells whether rows go on in that
    direction: one row more than the page is fetched, a top-k. The marker's first key is
    a bound that the scan can use. The next page's marker is the last row's keys, the
    previous page's the first row's."""
    from pyspark.sql import Window
    keys = list(keys)

    def beyond(i: int) -> Column:
        c, m = F.col(keys[i]), F.lit(marker[i])
        past = c < m if backward else c > m
        return past if i + 1 == len(keys) else past | ((c == m) & beyond(i + 1))

    if marker is not None:
        first = F.col(keys[0])
        df = df.where((first <= F.lit(marker[0])) if backward else (first >= F.lit(marker[0]))).where(beyond(0))
    order = [F.col(k).desc() if backward else F.col(k) for k in keys]
    fetched = df.orderBy(*order).limit(page_size + 1)
    # the windows run over those at most page_size + 1 rows
    ranked = (fetched.withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
              .withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > page_size))
    return ranked.where(F.col("_rn") <= page_size).drop("_rn").orderBy(*keys)


def summary_row(df: DataFrame, summations: Mapping[str, str]) -> DataFrame:
    """One row: per column its named summary over the non-null raw values of the
    whole (unfiltered) data; a column of nulls only gives null."""
    from cirrus.operators.aggregates import summary_expr
    return df.agg(*[summary_expr(method, F.col(c)).alias(f"{c}_{method}") for c, method in summations.items()])
