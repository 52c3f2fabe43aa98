import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestone import session

    spark = session.local_session(4, **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session.prepare(spark)
    spark.stop()
