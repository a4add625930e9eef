import pytest

from haplomesh.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = ship(local_session(4, partitions=4, name="tests"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
