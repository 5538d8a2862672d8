import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardlight.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folders = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = local_session(4, app="tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"}, **folders)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
