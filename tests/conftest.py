from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    place = tmp_path_factory.mktemp("spark")
    s = (SparkSession.builder.master("local[4]").appName("codexloom-tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.warehouse.dir", str(place / "warehouse")).config("spark.checkpoint.dir", f"file://{place}/shared").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
