"""A local session for tests, checks and the benchmark."""

import tempfile

from pyspark.sql import SparkSession


def local_session(name: str, cpus: int = 8, folder: str | None = None) -> SparkSession:
    """Local Spark without web page."""
    folder = folder or tempfile.mkdtemp(prefix="tripledger-")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .config("spark.log.level", "ERROR")
    )
    return builder.getOrCreate()
