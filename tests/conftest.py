import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scriptorium.session import get_spark  # noqa: E402
from scriptorium.streaming.events import STATE_STORE  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", 4, spark__sql__shuffle__partitions="4", spark__sql__streaming__stateStore__providerClass=STATE_STORE)
    yield s
    s.stop()


def values(df):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
