"""One local session for all tests; its stages go to a folder of the test run."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pelorus.session import session

    s = session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
