"""Spark session with the settings the engine relies on."""

import os

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "folioflow", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; under spark-submit the cluster's own settings win."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    builder = SparkSession.builder.appName(app)
    if "SPARK_ENV_LOADED" not in os.environ:
        builder = builder.master(f"local[{n}]").config("spark.driver.memory", "8g")
        builder = builder.config("spark.sql.shuffle.partitions", str(n))
    for k, v in (CONF | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
