"""Refresh strategies against a full rebuild, including what each one is known to miss."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from tripledger.operators import refresh
from tripledger.operators.metrics import (
    daily_metrics,
    month_over_month,
    month_over_month_join,
    month_over_month_lag,
    top_days,
    with_category_rank,
)
from tripledger.operators.facts import dim_zones, fct_trips
from tripledger.operators.staging import stage
from tripledger.sources.fixture import case_matrix, month_rows, zone_rows
from tripledger.sources.workdir import materialize


@pytest.fixture(scope="module")
def fct(spark):
    dim = dim_zones(zone_rows(spark))
    return materialize(fct_trips(stage(case_matrix(month_rows(spark, 2025, 7))), dim), "fct")


def until(fct, month):
    return fct.where(F.month("pickup_date") <= month)


def test_watermark_refresh_equals_rebuild_for_new_days(fct):
    target = daily_metrics(until(fct, 6))
    new = daily_metrics(refresh.since_last_date(fct, target))
    assert as_set(refresh.delete_insert(target, new, "date")) == as_set(daily_metrics(fct))


def test_watermark_refresh_of_an_empty_target_builds_everything(fct):
    target = daily_metrics(fct.limit(0))
    assert as_set(daily_metrics(refresh.since_last_date(fct, target))) == as_set(daily_metrics(fct))


def test_watermark_refresh_misses_late_rows_and_touched_dates_do_not(fct):
    late = fct.where("pickup_date = DATE '2025-02-15' AND payment_type = 'cash'")
    known = fct.exceptAll(late)
    target = materialize(daily_metrics(known), "target")
    by_watermark = refresh.delete_insert(
        target, daily_metrics(refresh.since_last_date(fct, target)), "date"
    )
    assert as_set(by_watermark) != as_set(daily_metrics(fct))
    by_touch = refresh.refresh_touched(target, fct, late, daily_metrics)
    assert as_set(by_touch) == as_set(daily_metrics(fct))


def test_key_replacement_keeps_vanished_dates_and_range_overwrite_does_not(fct):
    target = daily_metrics(fct)
    left = fct.where("pickup_date <> DATE '2025-07-01'")
    july = (dt.date(2025, 7, 1), dt.date(2025, 7, 31))
    new = daily_metrics(left, start=july[0], end=july[1])
    kept = refresh.delete_insert(target, new, "date")
    assert kept.where("date = DATE '2025-07-01'").count() == 1
    replaced = refresh.overwrite_range(target, new, "date", *july)
    assert as_set(replaced) == as_set(daily_metrics(left))


def test_stored_partitions(spark, fct, tmp_path):
    path = str(tmp_path / "daily")
    daily_metrics(until(fct, 6)).write.partitionBy("date").parquet(path)
    refresh.overwrite_partitions(daily_metrics(fct.where("month(pickup_date) >= 6")), path, "date")
    columns = daily_metrics(fct).columns
    assert as_set(spark.read.parquet(path).select(*columns)) == as_set(daily_metrics(fct))


def test_stored_range(spark, fct, tmp_path):
    daily_metrics(fct).write.partitionBy("date").option("path", str(tmp_path / "t")).saveAsTable(
        "range_target"
    )
    left = fct.where("pickup_date <> DATE '2025-06-01'").withColumn("revenue", F.col("revenue") + 1)
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    refresh.overwrite_table_range(
        spark, "range_target", daily_metrics(left), "date", dt.date(2025, 6, 1), dt.date(2025, 7, 31)
    )
    expected = refresh.overwrite_range(
        daily_metrics(fct), daily_metrics(left), "date", dt.date(2025, 6, 1), dt.date(2025, 7, 31)
    )
    columns = daily_metrics(fct).columns
    assert as_set(spark.table("range_target").select(*columns)) == as_set(expected)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def test_missing_days_and_ranges(spark):
    days = spark.createDataFrame(
        [("a", f"2025-01-{d:02d}") for d in (1, 2, 3, 3, 6, 7)] + [("b", "2024-12-31")],
        "k string, d string",
    ).withColumn("d", F.to_date("d"))
    start, end = dt.date(2025, 1, 1), dt.date(2025, 1, 7)
    a = days.where("k = 'a'")
    assert as_set(refresh.missing_days(a, "d", start, end)) == [
        (dt.date(2025, 1, 4),),
        (dt.date(2025, 1, 5),),
    ]
    assert refresh.missing_days(days, "d", start, end, ["k"]).where("k = 'b'").count() == 7
    assert refresh.missing_days(days.limit(0), "d", start, end).count() == 7
    assert refresh.missing_days(a, "d", dt.date(2025, 1, 1), dt.date(2025, 1, 3)).isEmpty()
    assert as_set(refresh.day_ranges(days, "d", ["k"], max_days=2)) == [
        ("a", dt.date(2025, 1, 1), dt.date(2025, 1, 3), 2),
        ("a", dt.date(2025, 1, 3), dt.date(2025, 1, 4), 1),
        ("a", dt.date(2025, 1, 6), dt.date(2025, 1, 8), 2),
        ("b", dt.date(2024, 12, 31), dt.date(2025, 1, 1), 1),
    ]


def test_growth_with_gaps_and_zeroes(spark):
    monthly = spark.createDataFrame(
        [("2024-12-01", 10, 5.0), ("2025-01-01", 15, 0.0), ("2025-02-01", 15, 3.0), ("2025-04-01", 1, 1.0)],
        "month string, trip_count bigint, revenue double",
    ).withColumn("month", F.to_date("month"))
    expected = [
        (dt.date(2024, 12, 1), 10, 5.0, None, None),
        (dt.date(2025, 1, 1), 15, 0.0, 0.5, -1.0),
        (dt.date(2025, 2, 1), 15, 3.0, 0.0, None),
        (dt.date(2025, 4, 1), 1, 1.0, None, None),
    ]
    for growth in (month_over_month, month_over_month_lag, month_over_month_join):
        assert as_set(growth(monthly)) == sorted(expected, key=repr)


def test_order_and_rank(spark):
    df = spark.createDataFrame([("b",), ("a",), ("x",)], "c string")
    ranked = dict(as_set(with_category_rank(df, "c", ["b", "a"], "rank")))
    assert ranked == {"b": 1, "a": 2, "x": None}
    daily = spark.createDataFrame(
        [("2025-01-02", 1.0), ("2025-01-01", 1.0), ("2025-01-03", 2.0)], "date string, total_revenue double"
    )
    assert [row.date for row in top_days(daily, 2).collect()] == ["2025-01-03", "2025-01-01"]
