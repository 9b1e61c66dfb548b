import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from tripledger.operators import groups, quality
from tripledger.operators.facts import dim_zones, fct_trips, unmatched_zones
from tripledger.operators.metrics import date_bounds
from tripledger.operators.staging import (
    classify_rejects,
    quality_filter,
    reject_counts,
    stage,
    typed_trips,
)
from tripledger.sources.fixture import case_matrix, month_rows, zone_rows


@pytest.fixture(scope="module")
def tables(spark):
    raw = case_matrix(month_rows(spark, 2025, 2))
    dim = dim_zones(zone_rows(spark))
    stg = stage(raw)
    return raw, stg, dim, fct_trips(stg, dim)


def test_reject_reasons(tables):
    counts = dict(as_set(reject_counts(tables[0])))
    assert counts == {
        "accepted": 18,
        "missing_pickup": 2,
        "missing_dropoff": 2,
        "negative_duration": 2,
        "excessive_duration": 2,
        "invalid_distance": 2,
        "invalid_total": 4,
    }


def test_classification_agrees_with_the_filter(spark, tables):
    raw = tables[0]
    for name in ("trip_distance", "total_amount", "fare_amount", "tip_amount", "tolls_amount"):
        for bad in (float("nan"), float("inf"), float("-inf"), None):
            raw = raw.unionAll(
                tables[0].where("case_name = 'card'").withColumn(name, F.lit(bad).cast("double"))
            )
    typed = typed_trips(raw)
    accepted = classify_rejects(typed).where("reject_reason IS NULL").drop("reject_reason")
    assert quality_filter(typed).exceptAll(accepted).isEmpty()
    assert accepted.exceptAll(quality_filter(typed)).isEmpty()
    assert accepted.count() == 18


def test_endpoints_are_inclusive(spark, tables):
    card = tables[0].where("case_name = 'card' AND month(month) = 1")
    noon = F.expr("TIMESTAMP_NTZ '2025-01-15 12:00:00'")
    edge = card.withColumn("tpep_pickup_datetime", noon).withColumn(
        "tpep_dropoff_datetime", noon + F.expr("INTERVAL 24 HOURS")
    )
    edge = edge.withColumn("total_amount", F.lit(10000.0))
    assert stage(edge).count() == 1
    assert stage(edge.withColumn("total_amount", F.lit(0.0))).count() == 1
    later = F.col("tpep_dropoff_datetime") + F.expr("INTERVAL 0.000001 SECOND")
    assert stage(edge.withColumn("tpep_dropoff_datetime", later)).count() == 0


def test_unmatched(tables):
    _, stg, dim, _ = tables
    assert dict(as_set(unmatched_zones(stg, dim))) == {"pickup": 2, "dropoff": 2, "either": 4}


def test_bad_reference_trips_the_check(spark, tables):
    _, _, dim, fct = tables
    empty = spark.createDataFrame([], "trip_count bigint")
    bad = fct.withColumn("pickup_zone_id", F.lit(999).cast("bigint"))
    report = dict(as_set(quality.quality_report(dim, bad, empty, empty, empty)))
    assert report["zone_references"] == 14
    assert report["daily_trip_count"] == report["zone_trip_count"] == 14
    assert report["zone_keys"] == report["timestamps"] == 0
    with pytest.raises(quality.QualityError):
        quality.gate(quality.quality_report(dim, bad, empty, empty, empty))


def test_report_on_empty_facts(spark, tables):
    _, _, dim, fct = tables
    empty = spark.createDataFrame([], "trip_count bigint")
    report = as_set(quality.quality_report(dim, fct.limit(0), empty, empty, empty))
    assert len(report) == 9 and {n for _, n in report} == {0}


@pytest.mark.parametrize(
    "ids", [[1, 2], [1, None], [None], []], ids=["plain", "with_null", "only_null", "empty"]
)
def test_not_in_follows_sql(spark, tables, ids):
    fct = tables[3]
    fct = (
        fct.unionAll(fct.withColumn("pickup_zone_id", F.lit(None).cast("bigint")))
        .unionAll(fct.withColumn("dropoff_zone_id", F.lit(999).cast("bigint")))
    )
    dim = spark.createDataFrame([(i,) for i in ids], "zone_id bigint")
    fct.createOrReplaceTempView("f")
    dim.createOrReplaceTempView("d")
    expected = spark.sql(
        "SELECT * FROM f WHERE pickup_zone_id NOT IN (SELECT zone_id FROM d) "
        "OR dropoff_zone_id NOT IN (SELECT zone_id FROM d)"
    )
    assert as_set(quality.not_in_references(fct, dim)) == as_set(expected)
    exists = spark.sql(
        "SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE zone_id = pickup_zone_id) "
        "OR NOT EXISTS (SELECT 1 FROM d WHERE zone_id = dropoff_zone_id)"
    )
    assert as_set(quality.bad_references(fct, dim)) == as_set(exists)


def test_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k bigint")
    assert as_set(quality.duplicate_keys(df, ["k"])) == [(1, 2)]
    assert quality.surplus_keys(df, "k").first()[0] == 3
    assert dict(as_set(quality.not_null(df, ["k"]))) == {"k": 2}
    parent = spark.createDataFrame([(1,), (None,)], "id bigint")
    assert as_set(quality.orphans(df, "k", parent, "id")) == [(2,)]


def test_nonfinite(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1.0D, 1), (CAST('NaN' AS DOUBLE), 2), "
        "(CAST('-Infinity' AS DOUBLE), 3), (NULL, 4) AS t(x, id)"
    )
    assert as_set(quality.nonfinite(df)) == [("x", 2)]


def test_date_bounds_cover_the_selection(spark, tables):
    raw = tables[0]
    assert as_set(date_bounds(raw, 2025, 2)) == [(dt.date(2025, 1, 1), dt.date(2025, 2, 28))]
    late = raw.withColumn("tpep_pickup_datetime", F.expr("TIMESTAMP_NTZ '2026-05-05 10:00:00'"))
    assert as_set(date_bounds(late, 2025, 12)) == [(dt.date(2025, 1, 1), dt.date(2026, 5, 5))]
    assert as_set(date_bounds(raw.limit(0), 2025, 12)) == [
        (dt.date(2025, 1, 1), dt.date(2025, 12, 31))
    ]


def test_groups(spark):
    df = spark.createDataFrame(
        [("g", "a", 1), ("g", "a", 1), ("g", "b", None), ("h", "a", 2), ("h", "b", 2), ("h", "z", 2),
         ("h", None, 2)],
        "g string, m string, v bigint",
    )
    assert as_set(groups.group_completeness(df, ["g"], "m", ["a", "b"])) == [
        ("g", "a", 2),
        ("h", "(other)", 2),
    ]
    assert as_set(groups.uniform_within_group(df, ["g"], ["v"])) == [("g", "v", "1", "1", 1)]
    assert as_set(groups.uniform_within_group(df, [], ["v"])) == [("v", "1", "2", 1)]


def test_uniform_compares_maps_without_order(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert as_set(groups.uniform_within_group(df, [], ["m"])) == []
