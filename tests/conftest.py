import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from millrace.session import local_session, ready  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle=4, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    ready(session)
    yield session
    session.stop()
