"""Sixteen named trip variants per base row, for checking every path of the cleaning rules."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.contract import RAW_TRIP_SCHEMA

# Case names in row order, and the fields each one overrides (SQL expressions).
# "base" is noon on the 15th of the month.
CASES = {
    "card": {},
    "cash": {"payment_type": "2", "tip_amount": "0.0"},
    "zero_distance": {"trip_distance": "0.0"},
    "zero_fare": {"fare_amount": "0.0"},
    "unknown_payment": {"payment_type": "99"},
    "null_passengers": {"passenger_count": "NULL"},
    "null_pickup": {"tpep_pickup_datetime": "NULL"},
    "negative_duration": {"tpep_dropoff_datetime": "base - INTERVAL 1 MINUTE"},
    "negative_distance": {"trip_distance": "-1.0"},
    "excessive_total": {"total_amount": "10001.0"},
    "invalid_pickup_zone": {"PULocationID": "999"},
    "invalid_dropoff_zone": {"DOLocationID": "999"},
    "excessive_duration": {"tpep_dropoff_datetime": "base + INTERVAL 2 DAYS"},
    "null_dropoff": {"tpep_dropoff_datetime": "NULL"},
    "negative_total": {"total_amount": "-5.0"},
    "month_boundary": {
        "tpep_pickup_datetime": "first",
        "tpep_dropoff_datetime": "first + INTERVAL 15 MINUTES",
    },
}

# The base row; fields not listed are 0.0.
BASE_ROW = {
    "VendorID": "1",
    "tpep_pickup_datetime": "base",
    "tpep_dropoff_datetime": "base + INTERVAL 15 MINUTES",
    "passenger_count": "1.0",
    "trip_distance": "2.0",
    "RatecodeID": "1.0",
    "store_and_fwd_flag": "'N'",
    "PULocationID": "1",
    "DOLocationID": "2",
    "payment_type": "1",
    "fare_amount": "10.0 + month(month)",
    "mta_tax": "0.5",
    "tip_amount": "2.0",
    "tolls_amount": "1.0",
    "improvement_surcharge": "1.0",
    "total_amount": "17.0 + month(month)",
    "cbd_congestion_fee": "2.5",
}

# The zones the cases refer to.
ZONES = [
    (1, "Synthetic Borough", "Synthetic Airport", "Airports"),
    (2, "Synthetic Borough", "Synthetic Downtown", "Yellow Zone"),
    (3, "Synthetic Borough", "Synthetic Unused Zone", "Boro Zone"),
]


def month_rows(spark: SparkSession, year: int, months: int, start_month: int = 1) -> DataFrame:
    """One row per month: ``month``, its first day."""
    return spark.range(start_month, start_month + months).select(
        F.make_date(F.lit(year), F.col("id").cast("int"), F.lit(1)).alias("month")
    )


def case_matrix(months: DataFrame) -> DataFrame:
    """Every row of ``months`` (column ``month``, a first of month) times sixteen cases: the raw
    trip columns plus ``month``, ``row_index`` and ``case_name``. No shuffle, no randomness."""
    rows = months.withColumn("first", F.col("month").cast("timestamp_ntz")).withColumn(
        "base", F.expr("first + INTERVAL 14 DAYS 12 HOURS")
    )
    # the base row is computed once per month row, and its cases are told apart by number
    base = [F.expr(BASE_ROW.get(f.name, "0.0")).cast(f.dataType).alias(f"_{f.name}") for f in RAW_TRIP_SCHEMA]
    rows = rows.select("month", "first", "base", *base)
    rows = rows.select("*", F.posexplode(F.array(*(F.lit(name) for name in CASES))).alias("row_index", "case_name"))
    columns = []
    for field in RAW_TRIP_SCHEMA:
        value = F.col(f"_{field.name}")
        for i, overrides in enumerate(CASES.values()):
            if field.name in overrides:
                other = F.expr(overrides[field.name]).cast(field.dataType)
                value = F.when(F.col("row_index") == i, other).otherwise(value)
        columns.append(value.alias(field.name))
    return rows.select("month", "row_index", "case_name", *columns)


def zone_rows(spark: SparkSession) -> DataFrame:
    """The zone lookup that belongs to the cases. Spark knows the size of literal rows, so joins to
    it are broadcasts; that of ``createDataFrame`` it takes for too large."""
    rows = ", ".join(map(str, ZONES))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS zones(LocationID, Borough, Zone, service_zone)").select(
        F.col("LocationID").cast("bigint").alias("LocationID"), "Borough", "Zone", "service_zone"
    )
