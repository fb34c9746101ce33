"""Row quality rules (re-aimed from the form validators): each rule is a
boolean Column; rows are split into valid and rejected and counted per rule."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IPV4, IPV6 = 1, 2          # version flags; both = IPV4 | IPV6

# An IPv4 octet 0-255 without leading zeros, a full dotted quad, and the short
# CIDR forms ('10/4', '128.0/16') that are accepted when a mask is given.
V4_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"{V4_OCTET}(?:\.{V4_OCTET}){{3}}"
V4_SHORT = rf"{V4_OCTET}(?:\.{V4_OCTET}){{0,3}}"
_H = r"[0-9a-fA-F]{1,4}"


def _groups(n: int) -> str:
    """``n`` colon-separated hex groups (empty for 0)."""
    return "" if n == 0 else rf"(?:{_H}:){{{n - 1}}}{_H}"


def _ipv6_pattern() -> str:
    """RFC 4291 text forms, generated from the rule "8 groups of 16 bits, one
    run of zero groups may be written '::', the last 32 bits may be a dotted
    quad" (each alternative: groups left of '::', groups right of it)."""
    alts = [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{6}}{V4}"]
    for left in range(8):
        for right in range(8 - left):
            alts.append(_groups(left) + "::" + _groups(right))
    for left in range(6):
        for right in range(6 - left):
            alts.append(_groups(left) + "::" + (rf"(?:{_H}:){{{right}}}" if right else "") + V4)
    return "(?:" + "|".join(alts) + ")"


V6 = _ipv6_pattern()


def valid_ip(c: Column, version: int = IPV4, mask: bool = False, min_mask: int = 0) -> Column:
    """Address (or, with ``mask``, network 'addr/len') validity for IPv4, IPv6 or
    both (``IPV4 | IPV6``). A network without '/len' is a host route; short IPv4
    forms are accepted for networks; the prefix length must lie in
    ``min_mask..32`` (IPv4) or ``min_mask..128`` (IPv6). Null or '' is invalid.

    Text with a ':' can only be IPv6, so only those rows meet the IPv6 pattern;
    the prefix is split off with plain string functions."""
    if mask:
        parts = F.split(c, "/")
        addr = F.element_at(parts, 1)
        plen_txt = F.try_element_at(parts, F.lit(2))
        plen = plen_txt.try_cast("int")
        one_slash = F.size(parts) <= 2
        no_len = F.size(parts) == 1
        len_ok = lambda hi: no_len | (plen_txt.rlike("^[0-9]{1,3}$") & plen.between(min_mask, hi))
        v4 = one_slash & addr.rlike(f"^{V4_SHORT}$") & len_ok(32)
        v6 = one_slash & addr.rlike(f"^{V6}$") & len_ok(128)
    else:
        addr = c
        v4 = c.rlike(f"^{V4}$")
        v6 = c.rlike(f"^{V6}$")
    ok = F.when(addr.contains(":"), v6 if version & IPV6 else F.lit(False)).otherwise(
        v4 if version & IPV4 else F.lit(False))
    return F.coalesce(ok, F.lit(False))


#: The least and largest port and protocol numbers (-1 stands for any).
PORTS = (-1, 65535)
PROTOCOLS = (-1, 255)


def valid_port(p: Column) -> Column:
    return F.coalesce(p.between(*PORTS), F.lit(False))


def valid_port_text(text: Column) -> Column:
    """'a' or 'a:b' of whole numbers that are valid ports; anything else is not."""
    parts = F.split(text, ":", -1)
    one = lambda x: x.rlike(r"^\s*[+-]?[0-9]+\s*$") & valid_port(F.trim(x).try_cast("long"))
    return F.coalesce((F.size(parts) <= 2) & F.forall(parts, one), F.lit(False))


def valid_port_range(lo: Column, hi: Column) -> Column:
    return valid_port(lo) & valid_port(hi) & (lo <= hi)


def valid_protocol(proto: Column) -> Column:
    return F.coalesce(proto.between(*PROTOCOLS), F.lit(False))


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n_pass, n_fail) in one aggregate over the data (no per-rule scan)."""
    aggs = []
    for name, cond in rules.items():
        aggs += [F.count_if(cond).alias(f"{name}__pass"), F.count_if(~cond).alias(f"{name}__fail")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}__pass`, `{n}__fail`" for n in rules)
    return wide.selectExpr(f"stack({len(rules)}, {stack}) AS (rule, n_pass, n_fail)")


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows passing every rule, rejected rows with the first failing rule)."""
    reason = None
    for name, cond in rules.items():
        reason = F.when(~cond, F.lit(name)) if reason is None else reason.when(~cond, F.lit(name))
    tagged = df.withColumn("reject_reason", reason)
    return tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"), \
        tagged.where(F.col("reject_reason").isNotNull())
