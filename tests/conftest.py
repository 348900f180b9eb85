import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import get_spark

    s = get_spark("tests", cores="4", partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    return DATA
