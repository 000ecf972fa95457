import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from activity_engine.session import local_session

    from activity_engine.session import checkpoint_dir

    s = local_session(cores=4, app="activity-engine-tests")
    checkpoint_dir(s)  # the configured folder, or a scratch one in tests only
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    from tests.oracle import duck

    return duck(SMALL)
