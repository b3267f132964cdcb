import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
for place in (HERE, HERE.parent):  # for the tests and, through the environment, for Spark's Python workers
    sys.path.insert(0, str(place))
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parent), str(HERE), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from hopwarden.session import local_session

    return local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
