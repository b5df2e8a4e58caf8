import sys
from contextlib import contextmanager
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyframe.session import local_session  # noqa: E402

TESTDATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", 4)
    yield session
    session.stop()


@pytest.fixture
def limits(spark):
    """Set size limits for one test, so that small data counts as hot."""
    @contextmanager
    def changed(**values):
        keys = [f"spark.tallyframe.{k}" for k in values]
        for key, value in zip(keys, values.values()):
            spark.conf.set(key, str(value))
        try:
            yield
        finally:
            for key in keys:
                spark.conf.unset(key)
    return changed


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples; NULLs first."""
    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, str(type(v)), v if v is not None else 0) for v in r])
    return collect
