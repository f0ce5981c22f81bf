import os

import pytest

from auralake.session import local_session

os.environ.setdefault("BENCH_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
