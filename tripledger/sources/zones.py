"""The zone lookup."""

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.contract import RAW_ZONE_SCHEMA
from tripledger.sources.months import path_must_exist


def read_zone_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a wrong header or an id that is no number fails the read."""
    reader = (
        spark.read.schema(RAW_ZONE_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
    )
    with path_must_exist(path):
        return reader.csv(path)


def check_zone_lookup(zones: DataFrame) -> None:
    """Raise ValueError unless the lookup can be read, has rows, and its ids are present and unique."""
    counts = zones.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("LocationID").alias("ids"))
    try:
        row = counts.first()
    except (PySparkException, Py4JError) as error:
        raise ValueError(f"zone lookup cannot be read: {str(error).splitlines()[0]}") from error
    if row.n == 0 or row.n != row.ids:
        raise ValueError(f"empty zone lookup or duplicate zone ids: {row.n} rows, {row.ids} ids")
