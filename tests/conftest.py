import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tiny_blocks(spark):
    """Three rows a block and no broadcast, so edges, carries and salts all take part."""
    spark.conf.set("spark.lapforge.blockRows", "3")
    spark.conf.set("spark.lapforge.hotRows", "5")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k in ("spark.lapforge.blockRows", "spark.lapforge.hotRows", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.unset(k)
