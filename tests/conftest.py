import os

os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest

from wavelens.session import session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    place = tmp_path_factory.mktemp("spark")
    s = session("tests", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.sql.warehouse.dir": str(place / "warehouse"), "spark.checkpoint.dir": f"file://{place}/shared"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
