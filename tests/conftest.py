from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark import cloudpickle

import corpusloom
from corpusloom.session import local_session

cloudpickle.register_pickle_by_value(corpusloom)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not Path(SMALL).is_dir():
        pytest.skip("test data is not there")
    return SMALL
