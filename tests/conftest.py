import pytest

from pricelode.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("pricelode-tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
