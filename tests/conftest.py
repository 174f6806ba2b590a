import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from stipendlens.plans.session import build_session  # noqa: E402
from tests.seed import seed_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="stipendlens-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    return seed_tables(spark)


def rows(df, *cols):
    """Ordered list of tuples of the chosen columns."""
    cols = cols or tuple(df.columns)
    return [tuple(r[c] for c in cols) for r in df.collect()]
