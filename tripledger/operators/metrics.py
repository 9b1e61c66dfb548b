"""Daily, zone and monthly metrics, and month-over-month growth."""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.functions.numeric import exact_sums, mean_of, merge_sums, partial_sums, safe_ratio


def _sums(df: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """Exact sums of columns under new names, and trip_count."""
    values = {name: F.col(column) for name, column in columns.items()}
    return exact_sums(df, keys, values).withColumnRenamed("row_count", "trip_count")


def daily_metrics(
    fct: DataFrame,
    fare_offset: float = 0.0,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """One row per pickup date, optionally of the dates from start to end (both inclusive).

    ``fare_offset`` shifts the displayed mean fare only; the sums that feed the monthly table
    do not move.
    """
    if start is not None:
        fct = fct.where(F.col("pickup_date") >= F.lit(start))
    if end is not None:
        fct = fct.where(F.col("pickup_date") <= F.lit(end))
    return daily_from_parts(daily_parts(fct), fare_offset)


DAILY_SUMS = {
    "revenue": "revenue",
    "fare": "fare_amount",
    "tip": "tip_amount",
    "percentage": "tip_percentage",
    "distance": "trip_distance",
    "minutes": "trip_duration_minutes",
}


def daily_parts(fct: DataFrame) -> DataFrame:
    """Partial exact sums per pickup date: a date has a few rows, by the magnitude of its values."""
    dated = fct.withColumn("date", F.col("pickup_date"))
    return partial_sums(dated, ["date"], {name: F.col(c) for name, c in DAILY_SUMS.items()})


def daily_from_parts(parts: DataFrame, fare_offset: float = 0.0) -> DataFrame:
    """The daily metrics of ``daily_parts``."""
    sums = merge_sums(parts, ["date"], list(DAILY_SUMS)).withColumnRenamed("row_count", "trip_count")
    mean_fare = mean_of("fare") + F.lit(fare_offset) if fare_offset else mean_of("fare")
    return sums.select(
        "date",
        "trip_count",
        F.col("revenue").alias("total_revenue"),
        mean_fare.alias("average_fare"),
        mean_of("percentage").alias("average_tip_percentage"),
        mean_of("distance").alias("average_trip_distance"),
        mean_of("minutes").alias("average_trip_duration"),
        F.col("fare").alias("fare_sum"),
        F.col("tip").alias("tip_sum"),
        F.col("distance").alias("distance_sum"),
    )


def zone_metrics(fct: DataFrame) -> DataFrame:
    """One row per pickup zone that has trips."""
    keys = ["pickup_zone_id", "pickup_zone"]
    sums = _sums(fct, keys, revenue="revenue", fare="fare_amount", distance="trip_distance")
    return sums.select(
        *keys,
        "trip_count",
        F.col("revenue").alias("total_revenue"),
        mean_of("fare").alias("average_fare"),
        mean_of("distance").alias("average_trip_distance"),
    )


def monthly_rollup(daily: DataFrame) -> DataFrame:
    """Months from days. Means are sum over sum, weighted by trips."""
    days = daily.withColumn("month", F.trunc("date", "MM"))
    names = ("total_revenue", "fare_sum", "tip_sum", "distance_sum")
    return exact_sums(days, ["month"], {n: F.col(n) for n in names}, ["trip_count"]).select(
        "month",
        "trip_count",
        F.col("total_revenue").alias("revenue"),
        (F.col("fare_sum") / F.col("trip_count")).alias("average_fare"),
        (F.col("tip_sum") / F.col("trip_count")).alias("average_tip"),
        (F.col("distance_sum") / F.col("trip_count")).alias("average_distance"),
    )


def zone_monthly(fct: DataFrame) -> DataFrame:
    """Trips and revenue per pickup zone and month."""
    months = fct.withColumn("month", F.trunc("pickup_date", "MM"))
    return _sums(months, ["pickup_zone_id", "month"], revenue="revenue").drop("revenue_count")


def _growth(name: str, previous: Column) -> Column:
    return safe_ratio(F.col(name) - previous, previous)


def _with_growth(table: DataFrame, columns: Sequence[str], trips: Column, revenue: Column):
    return table.select(
        *columns,
        _growth("trip_count", trips).alias("month_over_month_trip_growth"),
        _growth("revenue", revenue).alias("month_over_month_revenue_growth"),
    )


def month_over_month(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Growth against the calendar month before, as a fraction. NULL in the first month, after
    a gap and when the previous value is zero.

    Each row is sent to its own month and, as "previous", to the next one; one grouping by
    (keys, month) brings the two together. It is a single shuffle of the monthly rows: no
    table-wide window, and the upstream plan runs once where a self join would run it twice.
    """
    measures = [name for name in monthly.columns if name not in (*keys, "month")]
    this = F.struct(*measures)
    nothing = F.lit(None).cast(monthly.select(this).schema[0].dataType)
    offers = F.array(
        F.struct(F.col("month").alias("month"), this.alias("this"), nothing.alias("previous")),
        F.struct(
            F.add_months("month", 1).alias("month"), nothing.alias("this"), this.alias("previous")
        ),
    )
    paired = (
        monthly.select(*keys, F.inline(offers))
        .groupBy(*keys, "month")
        .agg(F.max("this").alias("this"), F.max("previous").alias("previous"))
        .where(F.col("this").isNotNull())
        .withColumn("previous", F.when(F.col("month").isNotNull(), F.col("previous")))
        .select(*keys, "month", "this.*", "previous")
    )
    return _with_growth(
        paired, monthly.columns, F.col("previous.trip_count"), F.col("previous.revenue")
    )


def month_over_month_lag(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same growth by LAG over the months of each key.

    Give keys wherever there are any: without them one task sorts all rows, which is only fit
    for a table with one row per month.
    """
    by_month = Window.partitionBy(*keys).orderBy("month")
    adjacent = F.col("month") == F.add_months(F.lag("month").over(by_month), 1)
    previous = monthly.select(
        "*",
        F.when(adjacent, F.lag("trip_count").over(by_month)).alias("_trips"),
        F.when(adjacent, F.lag("revenue").over(by_month)).alias("_revenue"),
    )
    return _with_growth(previous, monthly.columns, F.col("_trips"), F.col("_revenue"))


def month_over_month_join(monthly: DataFrame) -> DataFrame:
    """The same growth by joining each month to the one before."""
    previous = monthly.select(
        F.add_months("month", 1).alias("_next"),
        F.col("trip_count").alias("_trips"),
        F.col("revenue").alias("_revenue"),
    )
    joined = monthly.join(previous, F.col("month") == F.col("_next"), "left")
    return _with_growth(joined, monthly.columns, F.col("_trips"), F.col("_revenue"))


def monthly_metrics(daily: DataFrame) -> DataFrame:
    """Monthly rollup with growth."""
    return month_over_month(monthly_rollup(daily))


def date_bounds(raw: DataFrame, year: int, months: int, start_month: int = 1) -> DataFrame:
    """First and last event date, widened to the selected months (out-of-month rows count)."""
    first = dt.date(year, start_month, 1)
    after = start_month + months
    last = dt.date(year + (after > 12), (after - 1) % 12 + 1, 1) - dt.timedelta(days=1)
    event = F.to_date("tpep_pickup_datetime")
    return raw.agg(
        F.least(F.min(event), F.lit(first)).alias("start_date"),
        F.greatest(F.max(event), F.lit(last)).alias("end_date"),
    )


def payment_mix(stg: DataFrame) -> DataFrame:
    """Trips and total amount per payment label."""
    return _sums(stg, ["payment_type"], total_amount="total_amount").drop("total_amount_count")


def top_days(daily: DataFrame, n: int) -> DataFrame:
    """The n dates with the highest revenue; ties go to the earlier date."""
    return daily.orderBy(F.desc("total_revenue"), "date").limit(n)


def canonical_order(df: DataFrame) -> DataFrame:
    """Sort by every column, NULLs last."""
    return df.orderBy(*(F.col(name).asc_nulls_last() for name in df.columns))


def with_category_rank(df: DataFrame, column: str, order: Sequence[str], rank: str) -> DataFrame:
    """Add the position of a category in a custom order (from 1; NULL when not listed)."""
    position = F.array_position(F.array(*(F.lit(name) for name in order)), F.col(column))
    return df.withColumn(rank, F.nullif(position, F.lit(0)))
