import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MED = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fraudlens.session import get_session
    ck = tempfile.mkdtemp(prefix="fraudlens-test-ckpt-")
    s = get_session("local[4]", 8, extra={"spark.checkpoint.dir": ck,
                                          "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="fraudlens-test-")
