"""Enrichment operators over nested and ordered data.

Order-dependent rules carry an explicit position column; arrays are rebuilt with
``sort_array`` over ``struct(pos, value)`` (lexicographic, codegen'd; no lambda)
and the values read back with a struct-field projection, so the result does not
depend on shuffle order. Per-owner arrays are only built where an owner's list is bounded
by the data model (attachments of a volume, ports of a device).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.operators.joins import lookup


#: Items that one owner's list may have. It is a value of one row, so it has to fit in
#: a task's memory; a longer one is an error, never cut.
MAX_LIST = 1_000_000


def bounded(df: DataFrame, *owner: str, distinct: str | None = None, most: int | None = None) -> DataFrame:
    """``df``, once no owner has more than ``most`` rows (with ``distinct``, distinct
    values of that column): counted in an aggregate of its own, of numbers, which ends
    before any list is begun; a longer list is an error that names the count."""
    most = MAX_LIST if most is None else most
    rows = df.select(*owner, distinct).distinct() if distinct else df
    longest = F.coalesce(rows.groupBy(*owner).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar(), F.lit(0))
    return df.where(F.when(longest <= most, True).otherwise(F.raise_error(
        F.concat(F.lit(f"a list above {most} items: "), longest.cast("string"))).cast("boolean")))


def collect_list(item: Column, distinct: bool = False, most: int = MAX_LIST) -> Column:
    """An owner's items as a list (an aggregate; partial lists are made map-side).
    Fails when there are more than ``most``; the count of items, a number, is summed
    beside the list."""
    items = F.collect_set(item) if distinct else F.collect_list(item)
    return F.when(F.count(item) > most, F.raise_error(
        F.concat(F.lit(f"a list above {most} items: "), F.count(item).cast("string")))).otherwise(items)


def ordered_text(df: DataFrame, owner: str, pos: str, item: str, sep: str) -> DataFrame:
    """One text per owner: items in position order joined by ``sep`` (column ``text``)."""
    agg = bounded(df, owner).groupBy(owner).agg(
        F.sort_array(collect_list(F.struct(F.col(pos).alias("p"), F.col(item).alias("v")))).alias("_a"))
    return agg.select(owner, F.array_join(F.col("_a.v"), sep).alias("text"))


def ordered_array(df: DataFrame, owner: str, pos: str, value: str, name: str) -> DataFrame:
    """Per owner, the array of ``value`` in position order."""
    agg = bounded(df, owner).groupBy(owner).agg(
        F.sort_array(collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))).alias("_a"))
    return agg.select(owner, F.col("_a.v").alias(name))


def expand_id_array(df: DataFrame, owner: str, ids: str, records: DataFrame, record_key: str,
                    name: str) -> DataFrame:
    """Replace an id array by the array of records it names, in the same order;
    an unknown id becomes a null record (the element stays)."""
    rec_cols = [c for c in records.columns if c != record_key]
    exploded = df.select(owner, F.posexplode_outer(ids).alias("_pos", "_id"))
    j = lookup(exploded, records.withColumnRenamed(record_key, "_id"), "_id")
    rec = F.when(F.col("_id").isNull(), F.lit(None)).otherwise(
        F.struct(F.col("_id").alias(record_key), *[F.col(c) for c in rec_cols]))
    # A record whose id is known but absent from ``records`` keeps its id and null fields.
    # the arrays come from rows that hold them already, so their lengths are bounded
    agg = j.groupBy(owner).agg(F.sort_array(collect_list(F.struct(F.col("_pos").alias("p"), rec.alias("r")))).alias("_a"))
    return agg.select(owner, F.col("_a.r").alias(name))


def add_missing_edges(edges: DataFrame, wanted: DataFrame, keys: Sequence[str], owner: str) -> DataFrame:
    """Edges of the owners in ``wanted``, plus a placeholder edge for every wanted
    (owner, target) pair that has no edge row (``placeholder = true``)."""
    keys = list(keys)
    # per owner the edges wanted, then one pass over its edges; a wanted pair that
    # was met is counted once per pair, after the join
    want = wanted.select(*keys).distinct()
    marked = edges.select(*keys, F.lit(False).alias("placeholder")).unionByName(
        want.select(*keys, F.lit(True).alias("placeholder")))
    owners = want.select(F.col(owner).alias("_owner")).distinct()
    mine = marked.join(owners, F.col(owner) == F.col("_owner"), "left_semi")
    counted = mine.groupBy(*keys).agg(F.count_if(~F.col("placeholder")).alias("_edges"),
                                      F.bool_or("placeholder").alias("_wanted"))
    return counted.select(*keys, F.explode(F.when(
        F.col("_edges") > 0, F.array_repeat(F.lit(False), F.col("_edges").cast("int")))
        .when(F.col("_wanted"), F.array(F.lit(True)))).alias("placeholder"))


def diff_flags(rows: DataFrame, key: str, old: Column, new: Column) -> DataFrame:
    """Per key of rows flagged as old and as new: 'removed', 'kept' or 'added'; keys
    that are neither are left out. One scan, one aggregate."""
    flags = rows.groupBy(key).agg(F.bool_or(old).alias("_old"), F.bool_or(new).alias("_new"))
    is_old, is_new = F.coalesce("_old", F.lit(False)), F.coalesce("_new", F.lit(False))
    return flags.where(is_old | is_new).select(
        key, F.when(~is_new, "removed").when(~is_old, "added").otherwise("kept").alias("change"))


def diff_sets(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Compare two key sets: 'removed', 'kept' or 'added' per key."""
    both = old.select(key, F.lit(True).alias("_o")).unionByName(new.select(key, F.lit(False).alias("_o")))
    return diff_flags(both, key, F.col("_o"), ~F.col("_o"))


def diff_grant_flags(rows: DataFrame, current: Column, wanted: Column, acting_user, admin_role: str) -> DataFrame:
    """(user_id, role, action) of rows flagged as current and as wanted grants: 'add'
    for wanted only, 'revoke' for current only. If that would take the acting user's
    own admin role (in whatever case), every revoke of that user is 'blocked'."""
    flags = rows.groupBy("user_id", "role").agg(F.bool_or(current).alias("_c"), F.bool_or(wanted).alias("_w"))
    is_cur, is_want = F.coalesce("_c", F.lit(False)), F.coalesce("_w", F.lit(False))
    change = flags.where(is_cur != is_want).select(
        "user_id", "role", F.when(is_want, "add").otherwise("revoke").alias("action"))
    mine = F.col("user_id") == F.lit(acting_user)
    # one row at most per role of one user, read before the rest: a scalar, not a join
    lost = (rows.where(mine & (F.lower("role") == F.lit(admin_role.lower()))).groupBy("user_id", "role")
            .agg(F.coalesce(F.bool_or(current), F.lit(False)).alias("c"), F.coalesce(F.bool_or(wanted), F.lit(False)).alias("w"))
            .agg(F.coalesce(F.bool_or(F.col("c") & ~F.col("w")), F.lit(False)).alias("lost")))
    return change.withColumn("action", F.when(mine & (F.col("action") == "revoke") & lost.scalar(), F.lit("blocked"))
                             .otherwise(F.col("action")))


def diff_grants(want: DataFrame, current: DataFrame, acting_user, admin_role: str) -> DataFrame:
    """:func:`diff_grant_flags` for two tables of (user_id, role)."""
    both = want.select("user_id", "role", F.lit(True).alias("_want")).unionByName(
        current.select("user_id", "role", F.lit(False).alias("_want")))
    return diff_grant_flags(both, ~F.col("_want"), F.col("_want"), acting_user, admin_role)


def resolve_endpoint(ep: DataFrame, service: str, region: str, interface: str, fallback: str | None = None,
                     order: str = "s_suppkey") -> DataFrame:
    """Per service, the url of the first endpoint (by ``order``) for the region and
    interface; identity services ignore the region; then the fallback interface."""
    region_ok = (F.col("stype") == "identity") | (F.col("region") == region)
    first = F.min_by("url", F.when(region_ok & (F.col("iface") == interface), F.col(order)))
    exprs = [first]
    if fallback:
        exprs.append(F.min_by("url", F.when(region_ok & (F.col("iface") == fallback), F.col(order))))
    return ep.groupBy(service).agg(F.coalesce(*exprs).alias("url"))


# Fixed values (must equal the reference): per-type URL column -> interface name.
ENDPOINT_TYPE_TO_INTERFACE = {"publicURL": "public", "internalURL": "internal", "adminURL": "admin"}


def resolve_endpoint_typed(ep: DataFrame, service: str, region: str, endpoint_type: str = "publicURL",
                           fallback: str | None = None, order: str = "pos") -> DataFrame:
    """Older catalogue shape: each endpoint row carries one URL column per type
    (``publicURL``, ``internalURL``, ``adminURL``). The first endpoint of the
    region (any region for identity) decides; its URL of the requested type,
    else of the fallback type."""
    region_ok = (F.col("stype") == "identity") | (F.col("region") == region)
    cols = [c for c in ENDPOINT_TYPE_TO_INTERFACE if c in ep.columns]
    first = F.min_by(F.struct(*[F.col(c) for c in cols]), F.when(region_ok, F.col(order)))
    picked = ep.groupBy(service).agg(first.alias("_e"))
    urls = [F.col(f"_e.{endpoint_type}")] + ([F.col(f"_e.{fallback}")] if fallback else [])
    return picked.select(service, F.coalesce(*urls).alias("url"))


def meter_units(samples: DataFrame) -> DataFrame:
    """(meter, unit): the unit of the first sample (lowest ``event_id``) of every meter
    and of its rate ``<name>.rate``, '' for a name that no sample has."""
    # the first sample of each unit: two numbers, so the aggregate hashes
    small = F.coalesce(F.col("value") < 100, F.lit(False))
    first = samples.groupBy(F.col("event_type").alias("name")).agg(
        F.min(F.when(small, F.col("event_id"))).alias("a"), F.min(F.when(~small, F.col("event_id"))).alias("b"))
    unit = F.when(F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a") < F.col("b"))), "count").otherwise("B")
    asked = first.select(F.explode(F.array(F.col("name"), F.concat("name", F.lit(".rate")))).alias("meter")).distinct()
    units = first.select(F.col("name").alias("meter"), unit.alias("unit"))
    return lookup(asked, units, "meter").select("meter", F.coalesce("unit", F.lit("")).alias("unit"))
