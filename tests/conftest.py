from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from tessera.session import session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    made = session("local[4]", 4, **{"spark.driver.memory": "4g"})
    yield made
    made.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER
