import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cauza.session import local_session

    return local_session(cores=4, partitions=4, memory="4g", name="tests")


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
