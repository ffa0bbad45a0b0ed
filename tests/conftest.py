import os
import sys
from pathlib import Path

import pytest

HERE = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark():
    from lakeloom.session import build

    session = build("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
