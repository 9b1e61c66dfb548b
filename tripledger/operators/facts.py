"""The zone dimension and the trip facts."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.functions.numeric import failures, safe_ratio, to_bigint
from tripledger.functions.trip import revenue
from tripledger.operators.joins import flag_unknown, known_ids, lookup_join
from tripledger.sources.sinks import spread


def dim_zones(raw_zones: DataFrame) -> DataFrame:
    """Every row of the lookup, renamed and cast."""
    types = {field.name.lower(): field.dataType for field in raw_zones.schema}
    return raw_zones.select(
        to_bigint(F.col("LocationID"), types["locationid"]).alias("zone_id"),
        F.col("Borough").cast("string").alias("borough"),
        F.col("Zone").cast("string").alias("zone_name"),
        F.col("service_zone").cast("string").alias("service_zone"),
    )


def fct_trips(
    stg: DataFrame, dim: DataFrame, variant: str = "fare", small: bool | None = None
) -> DataFrame:
    """Staged trips whose pickup and dropoff zones are both known, with revenue and ratios.
    small: the dimension is known to fit a broadcast."""
    pickup = dim.select(F.col("zone_id").alias("_pickup"), F.col("zone_name").alias("pickup_zone"))
    dropoff = dim.select(
        F.col("zone_id").alias("_dropoff"), F.col("zone_name").alias("dropoff_zone")
    )
    joined = lookup_join(stg, pickup, [("pickup_zone_id", "_pickup")], small=small)
    joined = lookup_join(joined, dropoff, [("dropoff_zone_id", "_dropoff")], small=small)
    earned = revenue(variant)
    return joined.select(
        *stg.columns,
        "pickup_zone",
        "dropoff_zone",
        earned.alias("revenue"),
        safe_ratio(earned, F.col("trip_distance")).alias("revenue_per_mile"),
        safe_ratio(F.lit(100.0) * F.col("tip_amount"), F.col("fare_amount")).alias(
            "tip_percentage"
        ),
    )


PARTITION = "pickup_month"


def write_facts(fct: DataFrame, path: str, mode: str = "error") -> None:
    """Store facts by pickup month, each file sorted by pickup date.

    Months keep folders few and files large; the sort lets a reader skip row groups by date.
    """
    month = F.trunc("pickup_date", "MM").alias(PARTITION)
    (
        spread(fct.select("*", month), PARTITION)
        .sortWithinPartitions(PARTITION, "pickup_date")
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy(PARTITION)
        .parquet(path)
    )


def between_dates(stored: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Stored facts of the dates from start to end (inclusive), reading only their months."""
    month = F.col(PARTITION)
    return stored.where(
        month.between(F.lit(start.replace(day=1)), F.lit(end.replace(day=1)))
        & F.col("pickup_date").between(F.lit(start), F.lit(end))
    )


def with_zone_flags(trips: DataFrame, dim: DataFrame) -> DataFrame:
    """Add ``pickup_unknown`` and ``dropoff_unknown``: the zone id is NULL or not in ``dim``."""
    ids = known_ids(dim, "zone_id")
    trips = flag_unknown(trips, ids, "zone_id", "pickup_zone_id", "pickup_unknown")
    return flag_unknown(trips, ids, "zone_id", "dropoff_zone_id", "dropoff_unknown")


def unmatched_zones(stg: DataFrame, dim: DataFrame) -> DataFrame:
    """Staged trips the zone joins drop, by role: pickup, dropoff, and either of them."""
    pickup, dropoff = F.col("pickup_unknown"), F.col("dropoff_unknown")
    counts = with_zone_flags(stg, dim).agg(
        failures(pickup).alias("pickup"),
        failures(dropoff).alias("dropoff"),
        failures(pickup | dropoff).alias("either"),
    )
    return counts.unpivot([], ["pickup", "dropoff", "either"], "role", "unmatched_trips")
