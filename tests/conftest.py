import pytest

from loomwright.session import build


@pytest.fixture(scope="session")
def spark():
    return build("4", 4)
