from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from stratlens.session import local_session

    session = local_session("stratlens-tests", cores="4", shuffle_partitions=4)
    yield session
    session.stop()
