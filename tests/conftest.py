import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return DATA


@pytest.fixture(scope="session")
def skewed(spark):
    """20,000 packets; one flow holds a third of them. Ids are unique and dense."""
    from pyspark.sql import functions as F

    i = F.col("id")
    heavy = i % 3 == 0
    rank = F.pmod(F.xxhash64("id"), F.lit(2000))
    return spark.range(20000).select(
        i.alias("packet_id"),
        F.timestamp_seconds(1_700_000_000 + i / 10).alias("ts"),
        (i % 4).cast("int").alias("cpu"),
        F.when(heavy, 167772161).otherwise(167772162 + rank).cast("bigint").alias("src_ip"),
        F.lit(184549377).cast("bigint").alias("dst_ip"),
        F.when(heavy, 1234).otherwise(1024 + rank % 7).cast("int").alias("src_port"),
        F.lit(443).alias("dst_port"),
        F.lit(6).alias("proto"),
        F.lit(100).alias("wire_len"),
        F.lit("COUNTED").alias("verdict"),
    )
