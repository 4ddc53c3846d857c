import pytest

from docloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, app="docloom-tests")
    yield session
    session.stop()
