from __future__ import annotations

import pytest

from plumeframe.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cpus=4, memory="6g", app="plumeframe-tests")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()
