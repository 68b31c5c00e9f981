import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tilewright.session import local_session

    return local_session(cores=4, partitions=4)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
