import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from flowgrid.session import build_session

    session = build_session("tests", 4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
