import pytest

from folioforge.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, "4g")
    yield session
    session.stop()
