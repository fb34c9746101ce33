"""The command line lists, runs and explains catalogue queries."""

import contextlib
import io

from cirrus.__main__ import main


def test_list_shows_every_key():
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        assert main(["list"]) == 0
    lines = buf.getvalue().strip().splitlines()
    assert len(lines) == 140 and any(line.endswith("quota_usage") for line in lines)


def test_run_writes_output(spark, sf_small):
    from cirrus.session import scratch_dir
    out = scratch_dir(spark, "cli_out")
    assert main(["run", "container_totals", "--data", sf_small, "--out", out, "--format", "csv"]) == 0
    back = spark.read.option("header", "true").csv(out)
    assert set(back.columns) == {"container", "object_count", "bytes_used"} and back.count() > 0


def test_unknown_key_is_an_error():
    assert main(["run", "no_such_query", "--data", "/nowhere"]) == 2
