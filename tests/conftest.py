import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from leafspan.session import local_session

    return local_session(8, partitions=2, memory="4g", app="leafspan tests")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
