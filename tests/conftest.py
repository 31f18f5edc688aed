import pytest

from boskage.session import build


@pytest.fixture(scope="session")
def spark():
    session = build("local[4]", "boskage-tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session
