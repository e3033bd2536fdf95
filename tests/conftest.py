import os

os.environ.setdefault("ENGRAMIX_DRIVER_MEMORY", "4g")

import pytest

from engramix.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
