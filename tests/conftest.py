import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from loomwork.session import session

    s = session("4", "tests", **{"spark__sql__shuffle__partitions": "4", "spark__driver__memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return os.environ.get("LOOMWORK_TESTDATA", "/root/testdata/sf0.001")
