import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for Python workers


@pytest.fixture(scope="session")
def spark():
    from lectern.session import local_session

    session = local_session("4")
    session.conf.set("spark.sql.shuffle.partitions", "3")  # small tables: fewer tasks
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
