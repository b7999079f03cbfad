"""Session helper used by the command line, the tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "lodestar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; an existing session is reused as it is."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables of a data folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
