import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cryoframe.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    ship(s)
    yield s


@pytest.fixture
def tmp(tmp_path_factory):
    return str(tmp_path_factory.mktemp("data"))
