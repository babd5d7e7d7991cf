import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidewell.session import session

    shared = "file://" + str(tmp_path_factory.mktemp("shared"))
    s = session("local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__checkpoint__dir=shared)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
