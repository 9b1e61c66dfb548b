"""Places in a total order without sorting a table into one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.sources.workdir import materialize

PART = "__part"


def in_order(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """df, stored, with the number of its range partition: all rows of a lower one come first.

    Rows equal in all of `order` share a partition; a last column that differs lets them spread.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()), label)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, label: str) -> DataFrame:
    """df with `name`, the place of each row among those of its keys, from 0.

    Rows are dealt by range over keys and order, counted per partition and keys, and numbered
    within. A hot key spreads over many partitions; null is a key of its own.
    """
    placed = in_order(df, [*(F.col(k).asc_nulls_first() for k in keys), *order], label)
    counts = placed.groupBy(PART, *keys).agg(F.count("*").alias("__n"))
    # rows for each pair of keys and partition: as many as keys and partitions together
    upto = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(PART).alias("__p"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)),
        F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"),
    )
    own = placed.withColumn("__row", F.row_number().over(Window.partitionBy(PART, *keys).orderBy(*order)))
    same = F.col(PART) == F.col("__p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return own.join(starts, same).select(*df.columns, (F.col("__row") - 1 + F.col("__before")).alias(name))
