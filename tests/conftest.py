import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session, tune


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = tune(local_session(8, shuffle_partitions=4, app="tidemark-tests"))
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()
