import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from loregraph.session import get_spark

    s = get_spark("tests", 4, **{"spark.driver.memory": "4g", "spark.sql.warehouse.dir": "/tmp/loregraph-warehouse", "spark.log.level": "ERROR"})
    yield s
    s.stop()
