import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cirrus.session import get_session
    extra = {}
    # tests only: a local checkpoint root when the environment names none
    from pyspark import SparkConf
    if not SparkConf().get("spark.checkpoint.dir", None):
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="cirrus-test-ckpt-")
    extra["spark.sql.warehouse.dir"] = tempfile.mkdtemp(prefix="cirrus-test-warehouse-")
    s = get_session("local[*]", app="cirrus-tests", shuffle_partitions=8, extra=extra)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
