"""From raw trips to staged trips: rename, cast, derive, filter, account for rejects."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.contract import Bounds
from tripledger.functions.numeric import is_finite, to_bigint
from tripledger.functions.trip import elapsed_minutes, payment_label
from tripledger.operators.facts import PARTITION
from tripledger.sources.sinks import spread

OUTCOME, ACCEPTED = "outcome", "accepted"


def rename_cast(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The eleven contract columns, strictly cast: a malformed value fails the job (ANSI).
    Columns to ``keep`` pass through."""

    types = {field.name.lower(): field.dataType for field in raw.schema}

    def bigint(name: str) -> Column:
        return to_bigint(F.col(name), types[name.lower()])

    return raw.select(
        F.col("tpep_pickup_datetime").cast("timestamp_ntz").alias("pickup_datetime"),
        F.col("tpep_dropoff_datetime").cast("timestamp_ntz").alias("dropoff_datetime"),
        bigint("PULocationID").alias("pickup_zone_id"),
        bigint("DOLocationID").alias("dropoff_zone_id"),
        F.col("passenger_count").cast("double").alias("passenger_count"),
        F.col("trip_distance").cast("double").alias("trip_distance"),
        payment_label(F.col("payment_type")).alias("payment_type"),
        F.col("fare_amount").cast("double").alias("fare_amount"),
        F.col("tip_amount").cast("double").alias("tip_amount"),
        F.col("tolls_amount").cast("double").alias("tolls_amount"),
        F.col("total_amount").cast("double").alias("total_amount"),
        *keep,
    )


def derive_time(trips: DataFrame) -> DataFrame:
    """Add pickup date, pickup hour and the elapsed minutes."""
    return trips.select(
        "*",
        F.to_date("pickup_datetime").alias("pickup_date"),
        F.hour("pickup_datetime").alias("pickup_hour"),
        elapsed_minutes(F.col("pickup_datetime"), F.col("dropoff_datetime")).alias(
            "trip_duration_minutes"
        ),
    )


def quality_rules(bounds: Bounds) -> list[tuple[str, Column]]:
    """(reject reason, condition a good row meets), in the order rejects are attributed."""
    minutes = F.col("trip_duration_minutes")
    distance = F.col("trip_distance")
    total = F.col("total_amount")
    return [
        ("missing_pickup", F.col("pickup_datetime").isNotNull()),
        ("missing_dropoff", F.col("dropoff_datetime").isNotNull()),
        ("negative_duration", minutes >= 0.0),
        ("excessive_duration", minutes <= bounds.max_minutes),
        ("invalid_distance", is_finite(distance) & (distance >= 0.0)),
        ("invalid_total", is_finite(total) & total.between(0.0, bounds.max_total)),
        ("invalid_fare", is_finite(F.col("fare_amount"))),
        ("invalid_tip", is_finite(F.col("tip_amount"))),
        ("invalid_tolls", is_finite(F.col("tolls_amount"))),
    ]


def quality_filter(trips: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Rows that meet every rule; a rule that is NULL rejects. Negative fares, tips and tolls
    stay as long as the total passes."""
    return trips.where(reduce(Column.__and__, (good for _, good in quality_rules(bounds))))


def classify_rejects(trips: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Add ``reject_reason``: the first rule a row breaks, NULL for rows that pass."""
    reason = F.lit(None).cast("string")
    for name, good in reversed(quality_rules(bounds)):
        reason = F.when(~F.coalesce(good, F.lit(False)), name).otherwise(reason)
    return trips.withColumn("reject_reason", reason)


def typed_trips(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Renamed, cast and derived, not yet filtered."""
    return derive_time(rename_cast(raw, keep))


def stage(raw: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Raw trips to ``stg_trips``."""
    return quality_filter(typed_trips(raw), bounds)


def write_classified(raw: DataFrame, path: str, bounds: Bounds = Bounds(), only: str = "true") -> None:
    """Store every raw row once, typed, below ``path``: accepted rows in ``outcome=accepted``, by
    pickup month and sorted by date, the others in a folder per reject reason. Rows that do not
    meet the condition ``only`` on the typed columns are left out."""
    rows = classify_rejects(typed_trips(raw), bounds).where(only)
    accepted = F.col("reject_reason").isNull()
    rows = rows.withColumns({
        OUTCOME: F.coalesce("reject_reason", F.lit(ACCEPTED)),
        PARTITION: F.when(accepted, F.trunc("pickup_date", "MM")),  # odd dates make no folders
    }).drop("reject_reason")
    (
        spread(rows, OUTCOME, PARTITION)
        .sortWithinPartitions(OUTCOME, PARTITION, "pickup_date")
        .write.option("compression", "zstd")
        .partitionBy(OUTCOME, PARTITION)
        .parquet(path)
    )


def reject_counts(raw: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Rows per reject reason; accepted rows count as ``accepted``."""
    reason = F.coalesce("reject_reason", F.lit("accepted")).alias("reject_reason")
    return (
        classify_rejects(typed_trips(raw), bounds)
        .groupBy(reason)
        .agg(F.count(F.lit(1)).alias("trip_count"))
    )


def correct_fares(raw: DataFrame, amount: float = 1.0) -> DataFrame:
    """Add an amount to every finite fare; NULL, NaN, infinite fares and all other columns
    keep their values."""
    fare = F.col("fare_amount")
    return raw.withColumn("fare_amount", F.when(is_finite(fare), fare + amount).otherwise(fare))
