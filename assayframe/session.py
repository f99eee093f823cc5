"""Session settings that suit validation plans."""

from __future__ import annotations

from pyspark.sql import SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Set what the row pass depends on for speed; results do not change.

    The JVM never compiles a method of more than 8000 bytes, and Spark fuses all row rules into
    one method far above that. With this limit Spark runs such a plan operator by operator, in
    methods that do get compiled.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and measurements on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("assayframe")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        # one call into the JVM per expression instead of several; only error messages get shorter
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
