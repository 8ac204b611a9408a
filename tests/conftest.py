import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evenhand.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def base():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables not present")
    return SMALL


@pytest.fixture(scope="session")
def sample(spark, base):
    from evenhand.sources.applications import applications

    return applications(spark, base).persist()
