import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wakeline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
