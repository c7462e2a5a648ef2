import pytest

from runeloom.session import session


@pytest.fixture(scope="session")
def spark():
    return session(4, 4, "4g")
