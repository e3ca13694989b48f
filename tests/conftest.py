import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from docweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, **{"spark.driver.memory": "4g"})


def rows(df):
    """Rows as sorted tuples, arrays as tuples."""

    def plain(x):
        return tuple(plain(y) for y in x) if isinstance(x, (list, tuple)) else x

    return sorted((plain(tuple(r)) for r in df.collect()), key=repr)


@pytest.fixture
def collect():
    return rows
