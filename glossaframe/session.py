"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# SQL settings that may be changed on a running session.
SQL_SETTINGS = {
    # "col" is an identifier, as in standard SQL, not a string literal
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to an existing session and return it."""
    for name, value in SQL_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "glossaframe",
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, build your own and call `configure`."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # a duplicated speculative task would repeat paid labeler calls
        .config("spark.speculation", "false")
    )
    for name, value in SQL_SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
