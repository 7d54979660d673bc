import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from relvec.session import local_session

    shared = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = local_session("tests", cores=2, shuffle_partitions=3, **shared)
    yield session
    session.stop()


@pytest.fixture
def small():
    return "/root/testdata/sf0.001"
