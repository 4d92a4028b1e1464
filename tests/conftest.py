import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    """Small tables: interpreted expressions start faster than compiled ones."""
    from loomgraph.storage import session

    small = {
        "spark.sql.shuffle.partitions": "3", "spark.default.parallelism": "2", "spark.driver.memory": "4g", "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.autoBroadcastJoinThreshold": "1m", "spark.sql.adaptive.enabled": "false",
    }
    return session("tests", cores="4", **small)
