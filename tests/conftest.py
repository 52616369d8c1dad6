import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from docloom.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session("local[4]", 4, spark__checkpoint__dir=f"file://{shared}", spark__ui__enabled="false", spark__sql__warehouse__dir=str(shared / "warehouse"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
