"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyloom.session import make_session, ship


@pytest.fixture(scope="session")
def spark():
    session = make_session("local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
