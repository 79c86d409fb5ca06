"""One local session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import local, ship

    session = local(4, memory="4g", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    ship(session)
    yield session
    session.stop()
