"""Where intermediate tables go."""

import re
import tempfile
from functools import cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"tripledger-{application}-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only a session whose tasks run in the driver itself, as in tests, falls back to a temporary
    folder: on a cluster a driver-local path would be lost with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir(spark.sparkContext.applicationId)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/tripledger/{label}-{uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a result once and read it back, so that later uses neither recompute it nor
    depend on the executors that produced it."""
    path = fresh_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
