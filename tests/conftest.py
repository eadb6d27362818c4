import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from callqc.session import local_session

    s = local_session("*", 8, app="callqc-tests", warehouse=tempfile.mkdtemp(prefix="callqc-warehouse-"))
    if not s.conf.get("spark.checkpoint.dir", None):  # a cluster names its own
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="callqc-ckpt-"))
    yield s
    s.stop()
