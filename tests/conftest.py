from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from girder.session import build_session, importable  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = importable(build_session("girder-tests", 8))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
