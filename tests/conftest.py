from __future__ import annotations

import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "millrace-tests")
    yield session
    session.stop()
