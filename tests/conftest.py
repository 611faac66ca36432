"""One local session for all tests."""

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from parley.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__local__dir=tempfile.mkdtemp(prefix="spark-"), spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
