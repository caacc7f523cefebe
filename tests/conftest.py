import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session, ship

    session = local_session(4, app="tests", shuffle_partitions=4)
    ship(session)
    yield session
    session.stop()
