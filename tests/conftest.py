import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    # One JVM runs all tests. Spark starts a thread for each exchange and query stage, up to 1,024 of either, which live
    # for a minute: with many short queries that's more threads than a user may have. And no record of finished queries.
    threads = {f"spark.sql.{k}.maxThreadThreshold": 16 for k in ("shuffleExchange", "broadcastExchange", "resultQueryStage")}
    kept = {"spark.sql.ui.retainedExecutions": 5, "spark.ui.retainedJobs": 20, "spark.ui.retainedStages": 20, "spark.ui.retainedTasks": 500, "spark.driver.memory": "3g", **threads}
    s = SparkSession.builder.config(map=kept).master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
