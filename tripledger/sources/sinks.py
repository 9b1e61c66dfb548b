"""Table, CSV and JSON output."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 64


def with_salt(df: DataFrame, name: str) -> DataFrame:
    """Number rows round robin within their partition, up to the number of salts. Rows of equal
    content get different salts, and a repeated task gives the same ones to the same input."""
    return df.withColumn(name, F.monotonically_increasing_id() % salts(df.sparkSession))


def salts(spark: SparkSession) -> int:
    """As many as the session has cores to use at once, and SALTS at least."""
    return max(SALTS, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Bring rows of equal keys together for a partitioned write, without one task per key.

    Adaptive execution splits a key that holds much of the data over many tasks and packs small
    keys together. Where it is switched off, a salt bounds the share of a task.
    """
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        return df.hint("rebalance", *keys)
    return with_salt(df, "_salt").repartition(*keys, "_salt").drop("_salt")


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write zstd Parquet to a new folder, if wanted with a subfolder per partition value."""
    if partition_by:
        df = spread(df, partition_by)
    writer = df.write.mode("error").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def nested_as_json(df: DataFrame) -> DataFrame:
    """Map, array and struct columns as JSON text; other columns pass through."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    return df.select(
        *(
            F.to_json(F.col(f.name), {"ignoreNullFields": "false"}).alias(f.name)
            if isinstance(f.dataType, nested)
            else F.col(f.name)
            for f in df.schema
        )
    )


#: Cells keep their spaces and line ends; quotes inside a cell are doubled, as any CSV reader expects.
CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
#: No cell reads like this: a blank cell is NULL, and an empty text is written as two quotes.
NULL_CELL = "\u0000NULL\u0000"


def write_csv(df: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """CSV with a header; nested cells are JSON, NULL is blank and an empty text is ``""``.

    Cells may hold line ends, so a file cannot be read by several tasks; its size is bounded.
    """
    writer = nested_as_json(df).write.mode("error").options(**CSV)
    writer.option("maxRecordsPerFile", rows_per_file).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read what ``write_csv`` wrote; nested cells stay JSON text. Damage fails the read."""
    reader = spark.read.schema(schema).options(**CSV).option("multiLine", True)
    return reader.option("mode", "FAILFAST").option("nullValue", NULL_CELL).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per line, NULL fields kept."""
    df.write.mode("error").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType, array: bool = False):
    """JSON records: one per line, or with ``array`` one JSON list per file."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("multiLine", array).json(path)


def with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """Attach column comments, which catalog tables keep."""
    return df.select(
        *(
            F.col(name).alias(name, metadata={"comment": comments[name]})
            if name in comments
            else F.col(name)
            for name in df.columns
        )
    )


def table_schema(df: DataFrame) -> list[tuple[str, str]]:
    """Ordered (name, SQL type) pairs."""
    return [(field.name, field.dataType.simpleString()) for field in df.schema]
