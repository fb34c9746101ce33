"""Topology and dependency edges, hierarchical listings.

Everything is in long (node/edge per row) form: grouping a device list per
network, or a key listing per folder, is a sort or an aggregate, never a
collected array, so a network with a third of all devices is still spread over
range partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.operators.setops import union_typed


def listing_level(keys: DataFrame, key: str, depth: int = 1, delimiter: str = "/") -> DataFrame:
    """Prefix + delimiter listing for every prefix of ``depth`` segments at once:
    (prefix, entry, kind, n_keys), kind 'folder' when the key continues past the
    entry, else 'object'."""
    parts = F.split(F.col(key), delimiter)
    k = keys.select(parts.alias("_p")).where(F.size("_p") > depth)
    prefix = F.concat(F.array_join(F.slice("_p", 1, depth), delimiter), F.lit(delimiter))
    entry = F.try_element_at(F.col("_p"), F.lit(depth + 1))
    kind = F.when(F.size("_p") > depth + 1, F.lit("folder")).otherwise(F.lit("object"))
    return k.groupBy(prefix.alias("prefix"), entry.alias("entry"), kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n_keys"))


def list_prefix(keys: DataFrame, key: str, size: str, prefix: str = "", delimiter: str = "/") -> DataFrame:
    """What lies below any ``prefix`` up to the next ``delimiter``: (entry, kind, n_keys,
    n_bytes). Keys that go on past the delimiter are one 'folder' entry that ends in
    it, the others 'object's. The prefix need not end in the delimiter; it is a bound
    that the scan can use. An empty delimiter lists every key."""
    k = F.col(key)
    below = keys.where(k.startswith(prefix)) if prefix else keys.where(k.isNotNull())
    rest = F.substring(k, F.lit(len(prefix) + 1), F.length(k))
    at = F.locate(delimiter, rest) if delimiter else F.lit(0)
    entry = F.when(at > 0, F.substring(k, F.lit(1), at + (len(prefix) + len(delimiter) - 1))).otherwise(k)
    return below.groupBy(entry.alias("entry"), F.when(at > 0, "folder").otherwise("object").alias("kind")).agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum(size).alias("n_bytes"))


def folder_totals(keys: DataFrame, key: str, size: str, delimiter: str = "/") -> DataFrame:
    """(folder, depth, n_keys, n_bytes, n_direct) of every folder at every depth.

    Keys are totalled by the folder they lie in first, map-side, so a folder with a
    third of all keys is a row per task; only those totals, one for each folder that
    holds keys itself, are carried up to all ancestors. Keys without a folder are left out."""
    folder = F.substring(F.col(key), F.lit(1), F.length(F.col(key)) - F.length(F.substring_index(F.col(key), delimiter, -1)))
    own = (keys.select(folder.alias("_f"), F.col(size).alias("_s")).where(F.col("_f") != "")
           .groupBy("_f").agg(F.count(F.lit(1)).alias("_n"), F.sum("_s").alias("_s")))
    parts = F.split(F.col("_f"), delimiter, -1)
    up = own.select("_f", "_n", "_s", parts.alias("_p"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("_d"))
    path = F.concat(F.array_join(F.slice("_p", F.lit(1), F.col("_d")), delimiter), F.lit(delimiter))
    up = up.select(path.alias("folder"), F.col("_d").cast("long").alias("depth"), "_n", "_s",
                   F.when(F.col("_d") == F.size("_p") - 1, F.col("_n")).otherwise(0).alias("_own"))
    return up.groupBy("folder", "depth").agg(F.sum("_n").alias("n_keys"), F.sum("_s").alias("n_bytes"), F.sum("_own").alias("n_direct"))


def dependency_edges(nodes: DataFrame, node_id: str, required_by: str) -> DataFrame:
    """(source, target) pairs from each node's ``required_by`` list; targets must
    be existing nodes; duplicate pairs removed."""
    edges = nodes.select(F.col(node_id).alias("source"), F.explode(required_by).alias("target"))
    from cirrus.operators.joins import semi_join
    existing = nodes.select(F.col(node_id).alias("target"))
    return semi_join(edges, existing, "target").select("source", "target").distinct()


def assemble(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Node table from typed parts (each: id, label, parent_id), tagged by kind."""
    return union_typed(parts, tag="kind")


def devices_by_network(devices: DataFrame, network: str, kind_order: Sequence[str], kind: str = "kind",
                       device: str = "device") -> DataFrame:
    """Devices listed under their network, the kinds in the given order (e.g.
    routers before servers), with the per-network device count; a global sort,
    not a per-network collect."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kind_order]), F.col(kind))
    counts = devices.groupBy(network).agg(F.count(F.lit(1)).alias("n_devices"))
    return devices.join(counts, network).orderBy(network, rank, device)


def main_network(ports: DataFrame, device: str, network: str, position: str) -> DataFrame:
    """Each device's network with the lowest list position (``min_by``)."""
    return ports.groupBy(device).agg(F.min_by(network, F.struct(position, network)).alias(network))


def id_text(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))
