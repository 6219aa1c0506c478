import os
import sys

import pytest
from pyspark.sql import SparkSession
from toy import TOY

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("corepart-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def toy(spark):
    return spark.createDataFrame(TOY, "src bigint, dst bigint").cache()


@pytest.fixture(scope="session")
def hub_edges(spark):
    """Vertex 0 is an end of a third of all edges; the rest is random."""
    import random

    rnd = random.Random(3)
    rows = [(0, i) for i in range(1, 101)] + [(i, 0) for i in range(101, 151)]
    rows += [(rnd.randrange(1, 200), rnd.randrange(1, 200)) for _ in range(500)]
    return spark.createDataFrame(rows, "src bigint, dst bigint").cache()


@pytest.fixture
def sort_merge_only(spark):
    """Plans as they are for large tables, and before they run."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)
