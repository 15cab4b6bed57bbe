import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).parents[1]), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from contactloom.session import local_session

    session = local_session("tests", cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
