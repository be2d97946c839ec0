import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = os.environ.get("COHORTLAB_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from cohortlab.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4, app="cohortlab-tests")
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL
