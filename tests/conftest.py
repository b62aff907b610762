import os
import pathlib
import sys

import pytest

ROOT = str(pathlib.Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from blockloom.session import local_session

    session = local_session("tests", cores=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    if not DATA.exists():
        pytest.skip("no test data")
    return str(DATA)
