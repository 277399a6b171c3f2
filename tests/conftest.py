import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from assayer.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture
def many_buckets(monkeypatch):
    """Make even tiny tables take the multi-bucket path."""
    from assayer.operators import ranking

    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 5)
