import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from affinity.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    extra = {}
    # tests set their own checkpoint folder only when the session has none
    from pyspark import SparkConf
    if not SparkConf().get("spark.checkpoint.dir", None):
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="affinity-test-ckpt-")
    s = build_session("local[4]", app="affinity-tests", shuffle_partitions=8, extra=extra)
    yield s
    s.stop()


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="affinity-test-")
