import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests")


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TIDEMARK_TEST_SF", "/root/testdata/sf0.001")


def rows(df, *columns):
    """Rows as sorted tuples."""
    got = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in got), key=repr)
