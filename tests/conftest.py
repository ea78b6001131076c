import pytest

from ruleloom.session import build_session, release_staged


@pytest.fixture(scope="session")
def spark():
    session = build_session("ruleloom-tests", cores="4", partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release_staged(session)
    session.stop()
