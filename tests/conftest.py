import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from kgspark.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_session(os.environ.get("TEST_CPUS", "4"), 8)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"
