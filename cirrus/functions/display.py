"""Display expressions: every function takes and returns a ``Column``.

They are plain Catalyst expressions, so they stay inside whole-stage codegen and
run on the executors next to the scan; nothing here is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KB, _MB, _GB, _TB, _PB = (1024.0 ** i for i in range(1, 6))


# --- cell values --------------------------------------------------------------------------

def fill_empty(c: Column, empty_value: str = "-") -> Column:
    """Show ``empty_value`` only when the value is null ('' and 0 are kept)."""
    return F.coalesce(c.cast("string"), F.lit(empty_value))


def truncate_text(c: Column, size: int) -> Column:
    """Cut to ``size`` characters; when longer and ``size > 3`` end with '...'."""
    if size > 3:
        return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size - 3), F.lit("..."))).otherwise(c)
    return F.substring(c, 1, size)


def map_display_choices(c: Column, choices: Mapping[str, str],
                        filters: Sequence[Callable[[Column], Column]] = ()) -> Column:
    """Replace a value by its label (case-insensitive key match). When a label
    matched, the column filters are skipped; otherwise they run in order."""
    mapping = F.create_map(*[x for k, v in choices.items() for x in (F.lit(k.lower()), F.lit(v))])
    filtered = c
    for f in filters:
        filtered = f(filtered)
    return F.coalesce(mapping[F.lower(c.cast("string"))], filtered)


def name_or_id(name: Column, id_: Column, prefix_len: int | None = 13, parens: bool = True) -> Column:
    """Name when it is non-empty, else the id (its first ``prefix_len`` chars), in parentheses."""
    idtxt = id_.cast("string")
    short = F.substring(idtxt, 1, prefix_len) if prefix_len else idtxt
    fallback = F.concat(F.lit("("), short, F.lit(")")) if parens else short
    return F.coalesce(F.nullif(name, F.lit("")), fallback)


# --- sizes and numbers --------------------------------------------------------------------

def _num(x: Column, number: str) -> Column:
    if number == "int":
        return x.cast("bigint").cast("string")          # int(): truncate toward zero
    return F.format_string("%.1f", F.round(x, 1))        # one decimal, no grouping


def size_format(bytes_: Column, number: str = "float") -> Column:
    """Bytes as text with the largest unit below 1024 of the next: '512', '1.5 KB', ...
    Below 1024 there is no unit; null or non-numeric input gives '0 bytes'.
    Rounding is Spark's HALF_UP on the decimal value (see SURVEY Q12)."""
    b = bytes_.try_cast("double")
    return (F.when(b.isNull(), F.lit("0 bytes"))
            .when(b < _KB, b.cast("bigint").cast("string"))
            .when(b < _MB, F.concat(_num(b / _KB, number), F.lit(" KB")))
            .when(b < _GB, F.concat(_num(b / _MB, number), F.lit(" MB")))
            .when(b < _TB, F.concat(_num(b / _GB, number), F.lit(" GB")))
            .when(b < _PB, F.concat(_num(b / _TB, number), F.lit(" TB")))
            .otherwise(F.concat(_num(b / _PB, number), F.lit(" PB"))))


def mb_format(mb: Column) -> Column:
    """Megabytes as compact integer-unit text ('512MB', '2GB'); null or 0 -> '0'."""
    return F.when(F.coalesce(mb, F.lit(0)) == 0, F.lit("0")).otherwise(
        F.replace(size_format(mb.cast("double") * _MB, "int"), F.lit(" "), F.lit("")))


def mb_float_format(mb: Column) -> Column:
    """Megabytes as one-decimal text with a space ('1.5 GB'); null or 0 -> '0'."""
    return F.when(F.coalesce(mb, F.lit(0)) == 0, F.lit("0")).otherwise(size_format(mb.cast("double") * _MB))


def disk_gb_format(gb: Column) -> Column:
    """Gigabytes as one-decimal compact text ('20.0GB')."""
    return F.replace(size_format(gb.cast("double") * _GB), F.lit(" "), F.lit(""))


def bytes_to_gb_ceil(bytes_: Column) -> Column:
    """Round up to whole gigabytes."""
    return F.ceil(bytes_.cast("double") / _GB).cast("bigint")


def number_format(c: Column, decimals: int = 2) -> Column:
    """Fixed decimals with thousands commas ('1,234.50')."""
    return F.format_number(c, decimals)


def quota_label(value: Column, units: str | None = None) -> Column:
    """inf -> 'No Limit', else 'N [unit] Available'."""
    txt = F.when(value == F.lit(float("inf")), F.lit(None)).otherwise(
        F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string")))
    parts = [txt] + ([F.lit(units)] if units is not None else []) + [F.lit("Available")]
    return (F.when(value.isNull(), F.lit(None).cast("string"))
            .when(value == F.lit(float("inf")), F.lit("No Limit")).otherwise(F.concat_ws(" ", *parts)))


def flavor_label(name: Column, ram_mb: Column, vcpus: Column, disk_gb: Column) -> Column:
    """'name | 512MB RAM | 2 VCPU | 20.0GB Disk', or 'Not available' without a flavor."""
    txt = F.concat(name, F.lit(" | "), mb_format(ram_mb), F.lit(" RAM | "), vcpus.cast("string"),
                   F.lit(" VCPU | "), disk_gb_format(disk_gb), F.lit(" Disk"))
    return F.coalesce(txt, F.lit("Not available"))


# --- labels ---------------------------------------------------------------------------------

def replace_underscores(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def label_case(c: Column) -> Column:
    """'_' to space, then title case: a letter after anything but a letter, a digit or
    an apostrophe within a word is upper case ('Server-One', 'It's', '2nd'), others lower."""
    # the text is cut before each word start; a piece is capitalised at its first letter
    starts = r"(?<![\p{L}\p{N}])(?<!\p{L}')(?=\p{L})"
    pieces = F.split(F.lower(replace_underscores(c)), starts)
    return F.array_join(F.transform(pieces, capfirst), "")


def capfirst(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def admin_state(up: Column) -> Column:
    return F.when(up, F.lit("UP")).otherwise(F.lit("DOWN"))


# Fixed values (must equal the reference): power-state codes and their labels.
POWER_STATES = {
    0: "NO STATE", 1: "RUNNING", 2: "BLOCKED", 3: "PAUSED", 4: "SHUTDOWN",
    5: "SHUTOFF", 6: "CRASHED", 7: "SUSPENDED", 8: "FAILED", 9: "BUILDING",
}


def power_state_label(code: Column) -> Column:
    m = F.create_map(*[x for k, v in POWER_STATES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.coalesce(code, F.lit(0))], F.lit(""))


def direction_label(direction: Column) -> Column:
    return F.when(direction.isNull() | (F.lower(direction) == "ingress"), F.lit("Ingress")).otherwise("Egress")


def protocol_label(protocol: Column) -> Column:
    return F.coalesce(F.upper(protocol), F.lit("Any"))


def default_cidr(cidr: Column, ethertype: Column) -> Column:
    """Remote text: the CIDR, or the any-address of the IP version, plus ' (CIDR)'."""
    cidr = F.nullif(cidr, F.lit(""))
    any_net = F.when(ethertype == "IPv6", F.lit("::/0")).otherwise(F.lit("0.0.0.0/0"))
    return F.concat(F.coalesce(cidr, any_net), F.lit(" (CIDR)"))


def port_range_text(from_port: Column, to_port: Column) -> Column:
    """'a' when both ends are equal, else 'a - b'."""
    a, b = from_port.cast("string"), to_port.cast("string")
    return F.when(from_port == to_port, a).otherwise(F.concat(a, F.lit(" - "), b))


def named_port_range(from_port: Column, from_name: Column, to_port: Column, to_name: Column) -> Column:
    """'22 (SSH)', '22 (SSH) - 80 (HTTP)'; an end without a name is the number alone."""
    def end(port: Column, name: Column) -> Column:
        return F.concat(port.cast("string"), F.coalesce(F.concat(F.lit(" ("), name, F.lit(")")), F.lit("")))

    return F.when(from_port == to_port, end(from_port, from_name)).otherwise(
        F.concat(end(from_port, from_name), F.lit(" - "), end(to_port, to_name)))


def rule_text(ethertype: Column, protocol: Column, from_port: Column, to_port: Column,
              direction: Column, remote_group: Column, remote_cidr: Column) -> Column:
    """'ALLOW IPv4 80-90/tcp from 10.0.0.0/8' style sentence."""
    proto = F.lower(protocol)
    proto_num = protocol.try_cast("int")
    proto_port = (F.when(F.coalesce(from_port, F.lit(0)) != 0,
                         F.when(from_port == to_port, F.concat(from_port.cast("string"), F.lit("/"), proto))
                          .otherwise(F.concat(from_port.cast("string"), F.lit("-"), to_port.cast("string"),
                                              F.lit("/"), proto)))
                  .when(protocol.isNotNull() & (protocol != ""),
                        F.when(proto_num.isNotNull(), F.concat(F.lit("ip_proto="), proto_num.cast("string")))
                         .otherwise(protocol))
                  .otherwise(F.lit("")))
    dir_word = F.when(direction == "egress", F.lit("to")).otherwise(F.lit("from"))
    remote = F.coalesce(F.nullif(remote_group, F.lit("")), F.nullif(remote_cidr, F.lit("")), F.lit("ANY"))
    return F.concat_ws(" ", F.lit("ALLOW"), ethertype, proto_port, dir_word, remote)


# Fixed values (must equal the reference): ordered patterns for resource type and status.
RESOURCE_TYPE_RULES = [
    (("LoadBalancer",), "LB"),
    (("DBInstance", "Database"), "DB"),
    (("Instance", "Server"), "SERVER"),
    (("stack",), "STACK"),
]
RESOURCE_STATUS_RULES = [("IN_PROGRESS", "IN_PROGRESS"), ("FAILED", "FAILED"), ("DELETE", "DELETE"),
                         ("INIT", "INIT")]


def classify_type(c: Column) -> Column:
    """First matching substring rule wins; no match -> 'UNKNOWN'."""
    out = None
    for needles, label in RESOURCE_TYPE_RULES:
        cond = None
        for n in needles:
            cond = c.contains(n) if cond is None else (cond | c.contains(n))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit("UNKNOWN"))


def classify_status(c: Column) -> Column:
    out = None
    for needle, label in RESOURCE_STATUS_RULES:
        out = F.when(c.contains(needle), F.lit(label)) if out is None else out.when(c.contains(needle), F.lit(label))
    return out.otherwise(F.lit("COMPLETE"))


# --- maps, JSON -----------------------------------------------------------------------------

def map_entries_text(m: Column, sep: str = ", ") -> Column:
    """Map to 'k = v' items joined by ``sep`` (map order kept)."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), sep)


def metadata_name(m: Column) -> Column:
    """name, else display_name, else '' (empty strings count as missing)."""
    return F.coalesce(F.nullif(m["name"], F.lit("")), F.nullif(m["display_name"], F.lit("")), F.lit(""))


def to_json_text(*cols: Column | str, pretty: bool = False) -> Column:
    opts = {"pretty": "true"} if pretty else {}
    return F.to_json(F.struct(*cols), opts)


def variant_fields(df: DataFrame, meta: str) -> DataFrame:
    """``df`` with the fields of a VARIANT column ``meta`` in its place: ``kind`` of key k
    (missing, null, number, text, object, other), ``k_number``, ``name`` (k as text, or
    its own name), ``other_number`` and ``first_tag``; null where a field has another
    type. A JSON null and a missing key are told apart."""
    at = lambda path, kind: F.try_variant_get(F.col(meta), path, kind)
    k = F.try_variant_get(F.col(meta), "$.k", "variant")
    shape = F.schema_of_variant(k)
    kind = (F.when(k.isNull(), "missing").when(F.is_variant_null(k), "null").when(shape == "BIGINT", "number")
            .when(shape == "STRING", "text").when(shape.startswith("OBJECT"), "object").otherwise("other"))
    other = F.schema_of_variant(at("$.other.k", "variant"))
    return df.select(
        *[c for c in df.columns if c != meta], kind.alias("kind"), F.when(shape == "BIGINT", at("$.k", "bigint")).alias("k_number"),
        F.when(shape == "STRING", at("$.k", "string")).when(shape.startswith("OBJECT"), at("$.k.name", "string")).alias("name"),
        F.when(other.startswith("DECIMAL") | (other == "DOUBLE"), at("$.other.k", "double")).alias("other_number"),
        at("$.tags[0]", "string").alias("first_tag"))
