"""Sorting operators and sort-key expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE_RE = r"(?i)([\d\.,]+)\s*(byte|B|KB|MB|GB|TB|PB)+"
# Powers of 1024 per size unit.
SIZE_UNITS = {"BYTE": 0, "B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4, "PB": 5}


def sort_configured(df: DataFrame, config: Mapping, tiebreak: str | None = None) -> DataFrame:
    """Sort by ``config['key']``, descending when ``config['reverse']``."""
    c = F.col(config["key"])
    keys = [c.desc() if config.get("reverse") else c.asc()]
    if tiebreak:
        keys.append(F.col(tiebreak).asc())
    return df.orderBy(*keys)


def size_text_bytes(text: Column) -> Column:
    """Byte value of text such as '12.5 KB'. The number is read like parseFloat
    (leading digits and one dot; a comma ends it). Text without a unit is read
    like parseInt; no leading digit gives null."""
    num = F.regexp_extract(text, SIZE_RE, 1)
    unit = F.upper(F.regexp_extract(text, SIZE_RE, 2))
    lead = F.nullif(F.regexp_extract(num, r"^[0-9]*\.?[0-9]*", 0), F.lit("")).try_cast("double")
    units = F.create_map(*[x for k, v in SIZE_UNITS.items() for x in (F.lit(k), F.lit(v))])
    as_int = F.nullif(F.regexp_extract(text, r"^\s*[+-]?[0-9]+", 0), F.lit("")).try_cast("double")
    return F.when(unit != "", lead * F.pow(F.lit(1024.0), units[unit])).otherwise(as_int)


def ip_sort_keys(ip: Column) -> list[Column]:
    parts = F.split(ip, r"\.")
    return [F.try_element_at(parts, F.lit(i)).try_cast("int") for i in range(1, 5)]


def sort_by_ip(df: DataFrame, ip: str, tiebreak: str | None = None) -> DataFrame:
    """Dotted IPv4 text sorted numerically."""
    keys = ip_sort_keys(F.col(ip)) + ([F.col(tiebreak)] if tiebreak else [])
    return df.orderBy(*keys)


def sort_array_by(arr: Column, fields: Sequence[str], struct_fields: Sequence[str] | None = None) -> Column:
    """Sort an array of structs by the given fields. When they are the struct's
    leading fields in order, this is the codegen'd lexicographic ``sort_array``;
    otherwise an ``array_sort`` comparator (nulls last)."""
    if struct_fields is not None and list(struct_fields[:len(fields)]) == list(fields):
        return F.sort_array(arr)

    def cmp(a, b):
        out = F.lit(0)
        for f in reversed(fields):
            x, y = a[f], b[f]
            c = (F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), 1).when(y.isNull(), -1)
                 .when(x < y, -1).when(x > y, 1).otherwise(0))
            out = F.when(c != 0, c).otherwise(out)
        return out
    return F.array_sort(arr, cmp)


def last_n(df: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group under ``order`` (e.g. the last lines of
    a log when ordered descending). ``row_number() <= n`` lets Spark insert a
    partial WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_by_position(rows: DataFrame, owner: str, position: str, value: str, name: str) -> DataFrame:
    """(owner, ``name``): of each owner the long ``value`` at the lowest (position, value).
    Both are packed into a decimal of 38 digits, which holds any two such numbers (an
    int and a long) and, unlike a struct, is a buffer that the aggregate can hash."""
    wide, low = (F.lit(str(1 << bits)).cast("decimal(20,0)") for bits in (64, 63))
    place = (F.col(position).cast("decimal(10,0)") * wide).cast("decimal(38,0)") + (F.col(value).cast("decimal(20,0)") + low)
    best = rows.groupBy(owner).agg(F.min(place.cast("decimal(38,0)")).alias("_p"))
    return best.select(owner, (F.pmod(F.col("_p"), wide) - low).cast("long").alias(name))
