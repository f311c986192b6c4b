import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from spindrift.session import local_session

    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (sys.path[0], os.environ.get("PYTHONPATH")) if x)
    session = local_session(8, "4g", **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.sql.shuffle.partitions": "3"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
