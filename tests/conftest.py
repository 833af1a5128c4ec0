import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkwright.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[2]", shuffle_partitions=4, app_name="sparkwright-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session


def rows(df):
    return [r.asDict() for r in df.collect()]


def one(df):
    out = df.collect()
    assert len(out) == 1
    return out[0].asDict()
