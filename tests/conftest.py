import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from filingloom.session import local_session

    s = local_session(cpus=4, partitions=4, memory="4g")
    yield s
    s.stop()
