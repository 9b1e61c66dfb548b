"""Refreshing a keyed table: by key, by date range, by touched dates; day bookkeeping."""

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripledger.operators.facts import PARTITION
from tripledger.operators.joins import lookup_join
from tripledger.sources.sinks import spread
from tripledger.sources.workdir import materialize

def replace_keys(target: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop the target rows whose key is listed in ``keys``, then add ``new``."""
    listed = keys.select(F.col(key).alias("_replaced"))
    kept = lookup_join(target, listed, [(key, "_replaced")], "left_anti")
    return kept.unionByName(new)


def delete_insert(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Replace the keys that are present in ``new``; all other target rows stay, also those
    whose key no longer has any source rows."""
    new = materialize(new, "delete-insert")
    return replace_keys(target, new, new.select(key).distinct(), key)


def since_last_date(fct: DataFrame, target: DataFrame) -> DataFrame:
    """Facts from the target's last date on. That date is included, since it may have been
    incomplete; facts that arrive late for older dates are not. Of stored facts only the months
    from that date on are read."""
    earliest = F.make_date(F.lit(1), F.lit(1), F.lit(1))
    last = F.coalesce(F.max("date"), earliest)
    if PARTITION in fct.columns:
        fct = fct.where(F.col(PARTITION) >= target.agg(F.trunc(last, "MM")).scalar())
    return fct.where(F.col("pickup_date") >= target.agg(last).scalar())


def overwrite_range(
    target: DataFrame, new: DataFrame, date: str, start: dt.date, end: dt.date
) -> DataFrame:
    """Replace all dates from start to end (inclusive), also those that vanished."""
    inside = F.coalesce(F.col(date).between(F.lit(start), F.lit(end)), F.lit(False))
    return target.where(~inside).unionByName(new.where(inside))


def touched_dates(rows: DataFrame) -> DataFrame:
    """The pickup dates that occur in a set of facts."""
    return rows.select(F.col("pickup_date").alias("date")).distinct()


def facts_of_dates(fct: DataFrame, dates: DataFrame) -> DataFrame:
    """The facts of some dates. Of stored facts only the months of these dates are read: the
    list of months is fetched, which the calendar keeps short, so that Spark prunes the folders
    while planning."""
    if PARTITION in fct.columns:
        months = dates.select(F.trunc("date", "MM")).distinct().collect()
        fct = fct.where(F.col(PARTITION).isin([row[0] for row in months]))
    listed = dates.select(F.col("date").alias("_date"))
    return lookup_join(fct, listed, [("pickup_date", "_date")], "left_semi")


def refresh_touched(
    target: DataFrame,
    fct: DataFrame,
    new_rows: DataFrame,
    build: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Rebuild exactly the dates found in newly arrived rows, however old they are.

    ``fct`` holds all facts, the new ones included; ``build`` turns facts into target rows with
    a ``date``.
    """
    dates = materialize(touched_dates(new_rows), "touched")
    return replace_keys(target, build(facts_of_dates(fct, dates)), dates, "date")


def overwrite_partitions(new: DataFrame, path: str, key: str) -> None:
    """Replace, in a table folder partitioned by ``key``, the partitions present in ``new``."""
    (
        spread(new, key)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(key)
        .parquet(path)
    )


def overwrite_table_range(
    spark: SparkSession, table: str, new: DataFrame, key: str, start: dt.date, end: dt.date
) -> None:
    """Replace the range from start to end (inclusive) of a catalog table partitioned by the
    date column ``key``.

    Partitions present in ``new`` are overwritten, then those of the range that ``new`` lacks
    are dropped. Running it again after a failure gives the same table.
    """
    new = materialize(new.where(F.col(key).between(F.lit(start), F.lit(end))), "range")
    stored = spark.sql(f"SHOW PARTITIONS {table}").select(
        F.to_date(F.split("partition", "=")[1]).alias(key)
    )
    inside = stored.where(F.col(key).between(F.lit(start), F.lit(end)))
    vanished = inside.join(new.select(key).distinct(), key, "left_anti")
    # Partition names only: at most one per calendar day.
    gone = [row[0] for row in vanished.collect()]
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        columns = spark.table(table).columns
        spread(new.select(*columns), key).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)
    if gone:
        listed = ", ".join(f"PARTITION ({key} = DATE '{day}')" for day in gone)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {listed}")


def missing_days(
    processed: DataFrame, date: str, start: dt.date, end: dt.date, keys: Sequence[str] = ()
) -> DataFrame:
    """Days from start to end (inclusive) that were not processed, per key if there are keys.

    Each key collects its distinct days within the range, so no more than the calendar allows.
    """
    day = F.col(date).cast("date")
    expected = F.sequence(F.lit(start), F.lit(end))
    inside = F.when(day.between(F.lit(start), F.lit(end)), day)
    done = processed.groupBy(*keys).agg(F.collect_set(inside).alias("_done"))
    return done.select(
        *keys, F.explode(F.array_except(expected, F.col("_done"))).alias("missing_date")
    )


def day_ranges(
    days: DataFrame, date: str, keys: Sequence[str] = (), max_days: int = 3650
) -> DataFrame:
    """Runs of consecutive days as half-open ranges [start_date, end_date), cut after
    ``max_days``. Works on distinct days, so a key has at most one row per calendar day."""
    distinct = days.select(*keys, F.col(date).cast("date").alias("_day")).dropna().distinct()
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_day"))
    runs = (
        distinct.withColumn("_anchor", F.date_sub("_day", number))
        .groupBy(*keys, "_anchor")
        .agg(F.min("_day").alias("_first"), F.count(F.lit(1)).cast("int").alias("_length"))
    )
    pieces = runs.withColumn(
        "_offset", F.explode(F.sequence(F.lit(0), F.col("_length") - 1, F.lit(max_days)))
    )
    stop = F.least(F.col("_offset") + max_days, F.col("_length"))
    return pieces.select(
        *keys,
        F.date_add("_first", F.col("_offset")).alias("start_date"),
        F.date_add("_first", stop).alias("end_date"),
        (stop - F.col("_offset")).cast("bigint").alias("days"),
    )
