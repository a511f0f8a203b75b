import pytest

from folioworks.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, "tests", shuffle_partitions=4)
    yield s
    s.stop()
