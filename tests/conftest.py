"""Make the repository importable however pytest is started."""
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quern.session import local_session

    cores = int(os.environ.get("TEST_CORES", "4"))
    return local_session(cores=cores, partitions=4, memory="4g", spark__default__parallelism="4")
