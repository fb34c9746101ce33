"""Property tests: library expressions against small Python models of the
semantics they implement, on generated inputs (one Spark job per property)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cirrus.operators import table as TB
from cirrus.operators.sorting import size_text_bytes


def wildcard_model(name: str, filter_string: str) -> bool:
    """Only the first space-separated term counts; its '*'-separated parts must
    occur in order without overlapping; a term with no text matches all."""
    term = filter_string.lower().strip().split(" ")[0]
    s, pos = name.lower(), 0
    for part in (p for p in term.split("*") if p):
        i = s.find(part, pos)
        if i < 0:
            return False
        pos = i + len(part)
    return True


ALPHA = st.text(alphabet="ab%_\\", min_size=0, max_size=6)
PATTERN = st.text(alphabet="aAb*%_\\ ", min_size=0, max_size=6)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(ALPHA, PATTERN), min_size=50, max_size=50))
def test_wildcard_matches_model(spark, pairs):
    rows = [(n, TB.wildcard_like_pattern(q), wildcard_model(n, q)) for n, q in pairs]
    df = spark.createDataFrame(rows, "name string, pat string, want boolean")
    got = df.select(F.expr("lower(name) LIKE pat ESCAPE '\\\\'").alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def size_model(text: str):
    """parseFloat of the number before a size unit times 1024^k; without a unit,
    parseInt of the leading integer; nothing numeric -> None."""
    import re
    units = {"BYTE": 0, "B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4, "PB": 5}
    m = re.search(r"([\d\.,]+)\s*(byte|B|KB|MB|GB|TB|PB)+", text, re.I)
    if m:
        lead = re.match(r"[0-9]*\.?[0-9]*", m.group(1)).group(0)
        return float(lead) * 1024.0 ** units[m.group(2).upper()] if lead not in ("", ".") else None
    i = re.match(r"\s*[+-]?[0-9]+", text)
    return float(i.group(0)) if i else None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 99999), st.sampled_from(["", ".5", ",3"]),
                          st.sampled_from(["", " ", "  "]), st.sampled_from(["KB", "mb", "GB", "B", "bytes", ""])),
                min_size=40, max_size=40))
def test_size_text_matches_model(spark, parts):
    texts = [f"{a}{b}{c}{d}" for a, b, c, d in parts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(size_text_bytes(F.col("t"))).collect()]
    assert got == [size_model(t) for t in texts]
