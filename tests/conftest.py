import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
         .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def mixed(spark):
    """A table with nulls, repeats, ties and a skewed column (a third of the rows share one key)."""
    rows = []
    for i in range(900):
        key = 7 if i % 3 == 0 else i
        x = None if i % 11 == 0 else float((i * 37) % 101)
        y = float((i * i) % 53) if i % 5 else None
        z = 1000.0 if i % 60 == 0 else float(i % 17)
        rows.append((i, key, x, y, z, "ab"[i % 2]))
    return spark.createDataFrame(rows, "id int, key int, x double, y double, z double, flag string").repartition(3)
