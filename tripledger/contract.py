"""The shared data contract: column names, labels and bounds.

Everything in this module is a fixed value that results depend on.
"""

from dataclasses import dataclass

from pyspark.sql import types as T

# Payment codes and their labels. Any other code, and NULL, is "unknown".
PAYMENT_LABELS = {
    1: "credit_card",
    2: "cash",
    3: "no_charge",
    4: "dispute",
    5: "unknown",
    6: "voided",
}
UNKNOWN_PAYMENT = "unknown"

# The raw trip file layout (public taxi trip records).
RAW_TRIP_SCHEMA = T.StructType(
    [
        T.StructField("VendorID", T.LongType()),
        T.StructField("tpep_pickup_datetime", T.TimestampNTZType()),
        T.StructField("tpep_dropoff_datetime", T.TimestampNTZType()),
        T.StructField("passenger_count", T.DoubleType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("RatecodeID", T.DoubleType()),
        T.StructField("store_and_fwd_flag", T.StringType()),
        T.StructField("PULocationID", T.LongType()),
        T.StructField("DOLocationID", T.LongType()),
        T.StructField("payment_type", T.LongType()),
        T.StructField("fare_amount", T.DoubleType()),
        T.StructField("extra", T.DoubleType()),
        T.StructField("mta_tax", T.DoubleType()),
        T.StructField("tip_amount", T.DoubleType()),
        T.StructField("tolls_amount", T.DoubleType()),
        T.StructField("improvement_surcharge", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("congestion_surcharge", T.DoubleType()),
        T.StructField("Airport_fee", T.DoubleType()),
        T.StructField("cbd_congestion_fee", T.DoubleType()),
    ]
)
RAW_ZONE_SCHEMA = T.StructType(
    [
        T.StructField("LocationID", T.LongType()),
        T.StructField("Borough", T.StringType()),
        T.StructField("Zone", T.StringType()),
        T.StructField("service_zone", T.StringType()),
    ]
)
# What an input folder holds.
REQUIRED_TRIP_COLUMNS = ("tpep_pickup_datetime", "tpep_dropoff_datetime", "PULocationID")
MONTH_FILE = "yellow_tripdata_{year}-{month:02d}.parquet"
ZONE_FILE = "taxi_zone_lookup.csv"

# The published tables, in build order.
TABLES = (
    "stg_trips",
    "dim_zones",
    "fct_trips",
    "daily_metrics",
    "zone_metrics",
    "monthly_metrics",
)

TABLE_COMMENTS = {
    "stg_trips": "Typed and cleaned trips; rows that break a quality rule are left out.",
    "dim_zones": "Every zone of the lookup, used or not.",
    "fct_trips": "Staged trips whose two zones are known; duplicates are kept.",
    "daily_metrics": "One row per pickup date, with the sums monthly means need.",
    "zone_metrics": "One row per pickup zone over the whole selection.",
    "monthly_metrics": "Trip-weighted monthly means and month-over-month growth.",
}

COLUMN_COMMENTS = {
    "stg_trips": {"pickup_date": "Calendar date of the pickup.", "trip_duration_minutes": "Dropoff minus pickup."},
    "dim_zones": {"zone_id": "Unique, never NULL."},
    "fct_trips": {
        "revenue": "What counts as income of a trip; its definition is a parameter of the build.",
        "revenue_per_mile": "NULL for a trip without distance.",
        "pickup_month": "First day of the pickup month: the folders of the table. Filter on it to read few.",
    },
    "daily_metrics": {"date": "Unique, never NULL.", "fare_sum": "Kept for the monthly mean."},
    "zone_metrics": {"pickup_zone_id": "Unique, never NULL."},
    "monthly_metrics": {"month_over_month_trip_growth": "Fraction of the month before; NULL after a gap."},
}


@dataclass(frozen=True)
class Bounds:
    """Accepted ranges; both ends are inclusive."""

    max_minutes: float = 1440.0
    max_total: float = 10000.0
