import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablemill.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, partitions=8, memory="8g")
    yield session
    session.stop()
