from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from quillmark.session import release_scratch

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.executorEnv.PYTHONPATH", str(ROOT)).getOrCreate()
    )
    s.sparkContext.environment["PYTHONPATH"] = str(ROOT)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    release_scratch(s)
    s.stop()
