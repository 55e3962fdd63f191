import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("spanveil-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def find(spark):
    """Detect on (id, text) rows; gives (accepted by id, rejected by id)."""
    from spanveil.operators.detect import detect

    def run(texts, **options):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        rows = detect(df, rejected="rejected", **options).collect()
        return ({r.id: [s.asDict() for s in r.spans] for r in rows},
                {r.id: [s.asDict() for s in r.rejected] for r in rows})

    return run
