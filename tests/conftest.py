import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from staylens.session import build_session
    s = build_session("local[4]", app="staylens-tests", shuffle_partitions=8,
                      extra_conf={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="staylens-wh-")})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    """A fresh scratch folder per test (never reused, never cleared)."""
    return tempfile.mkdtemp(prefix="staylens-test-")
