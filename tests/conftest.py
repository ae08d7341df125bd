import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketcast.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(master=os.environ.get("TEST_MASTER", "local[4]"), app_name="basketcast-tests", shuffle_partitions=4)
    yield session
    session.stop()
