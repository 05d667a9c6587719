from __future__ import annotations

import os
import sys

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scriptorium.session import get_session

    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = get_session(4, 4, app="tests", spark_sql_warehouse_dir=warehouse)
    yield session
    session.stop()
