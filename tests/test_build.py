"""The six tables over the sixteen-case fixture, against hand-computed values."""

import datetime as dt
import glob
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from tripledger.contract import TABLES
from tripledger.operators import records
from tripledger.operators.compare import compare_all, table_checksum
from tripledger.operators.facts import between_dates
from tripledger.operators.quality import QualityError
from tripledger.operators.refresh import facts_of_dates, since_last_date
from tripledger.operators.staging import correct_fares, reject_counts
from tripledger.plans import publish
from tripledger.plans.build import append, build_from_files, build_summary, build_tables, report_for, restate, run_record
from tripledger.plans.publish import audit_publish, environment_checksums, point_views
from tripledger.sources.fixture import zone_rows
from tripledger.sources.months import read_months
from tripledger.sources.versions import parts
from tripledger.sources.zones import read_zone_csv


@pytest.fixture(scope="module")
def half_year(spark, raw_dir):
    return build_from_files(spark, raw_dir, 2025, 6)


def test_row_counts(spark, half_year):
    assert half_year.input_rows == 96
    assert [half_year.rows[name] for name in TABLES] == [54, 3, 42, 12, 1, 6]
    assert half_year.rejected_staging_rows == 42
    assert half_year.rejected_zone_rows == 12
    assert dict(as_set(build_summary(spark, half_year)))["rejected_zone"] == 12


def test_january_and_growth(spark, half_year):
    months = half_year.table(spark, "monthly_metrics").orderBy("month").collect()
    first, second = months[0], months[1]
    assert (first.month, first.trip_count, first.revenue) == (dt.date(2025, 1, 1), 7, 66.0)
    assert first.average_fare == pytest.approx(66 / 7, rel=1e-15)
    assert first.average_tip == pytest.approx(12 / 7, rel=1e-15)
    assert first.average_distance == pytest.approx(12 / 7, rel=1e-15)
    assert first.month_over_month_trip_growth is None
    assert first.month_over_month_revenue_growth is None
    assert second.month_over_month_trip_growth == 0.0
    assert second.month_over_month_revenue_growth == pytest.approx(6 / 66, rel=1e-15)


def test_ratios_and_labels(spark, half_year):
    fct = half_year.table(spark, "fct_trips")
    assert fct.where("revenue_per_mile IS NULL").count() == 6
    assert fct.where("tip_percentage IS NULL").count() == 6
    assert fct.where("payment_type = 'unknown'").count() == 6
    assert fct.where("passenger_count IS NULL").count() == 6


def test_mean_tip_percentage_is_the_plain_average(spark, half_year):
    plain = half_year.table(spark, "fct_trips").groupBy(F.col("pickup_date").alias("date")).agg(
        F.avg("tip_percentage").alias("plain")
    )
    joined = half_year.table(spark, "daily_metrics").join(plain, "date").collect()
    assert len(joined) == 12
    for row in joined:
        assert row.average_tip_percentage == pytest.approx(row.plain, rel=1e-12)


def test_records_of_verified_runs(spark, raw_dir, half_year):
    members = ["first", "second"]
    other = build_from_files(spark, raw_dir, 2025, 6)
    run = {
        "run_id": "r",
        "scenario": "initial_build",
        "dataset_kind": "fixture",
        "dataset_year": 2025,
        "dataset_months": 6,
        "start_month": 1,
    }
    runs = [
        run_record(spark, build, {**run, "implementation": name}, 1.5, "full_rebuild")
        for name, build in zip(members, (half_year, other))
    ]
    runs = runs[0].unionAll(runs[1])
    assert {row.status for row in runs.collect()} == {"built"}
    report = compare_all(
        spark,
        half_year.tables(spark),
        {"first": half_year.tables(spark), "second": other.tables(spark)},
    )
    verdicts = report.select(
        F.col("candidate").alias("implementation"), F.col("equivalent").alias("passed")
    )
    done = records.run_status(runs, verdicts, "implementation").select(*records.RECORD_SCHEMA.names)
    row = done.where("implementation = 'second'").first()
    assert (row.status, row.equivalent, row.input_rows) == ("verified", True, 96)
    assert row.output_rows["fct_trips"] == 42 and row.database_size_mb > 0
    assert records.classify_records(done, members).where("reject_reason IS NOT NULL").isEmpty()
    assert records.set_problems(done, members).isEmpty()


def test_output_contract(spark, half_year):
    daily = dict(half_year.table(spark, "daily_metrics").dtypes)
    assert daily["date"] == "date" and daily["trip_count"] == "bigint"
    assert all(kind == "double" for name, kind in daily.items() if name not in ("date", "trip_count"))
    stg = half_year.table(spark, "stg_trips")
    assert stg.columns[0] == "pickup_datetime" and stg.columns[-1] == "trip_duration_minutes"
    assert dict(stg.dtypes)["pickup_datetime"] == "timestamp_ntz"
    assert dict(stg.dtypes)["pickup_hour"] == "int"
    fct = half_year.table(spark, "fct_trips")
    assert fct.columns == stg.columns + [
        "pickup_zone",
        "dropoff_zone",
        "revenue",
        "revenue_per_mile",
        "tip_percentage",
    ]


def test_rebuild_is_identical_and_checks_pass(spark, raw_dir, half_year):
    again = build_from_files(spark, raw_dir, 2025, 6)
    report = compare_all(spark, half_year.tables(spark), {"again": again.tables(spark)})
    assert report.where("NOT equivalent").count() == 0
    for name in TABLES:
        assert (
            table_checksum(half_year.table(spark, name)).first()
            == table_checksum(again.table(spark, name)).first()
        )
    assert report_for(spark, half_year).where("failures <> 0").count() == 0


def test_new_month_and_shrinking_selection(spark, raw_dir, half_year):
    grown = build_from_files(spark, raw_dir, 2025, 7)
    assert [grown.rows[name] for name in TABLES] == [63, 3, 49, 14, 1, 7]
    one = build_from_files(spark, raw_dir, 2025, 1)
    assert (one.input_rows, one.rows["fct_trips"]) == (16, 7)


def test_appended_months_equal_a_rebuild(spark, raw_dir, half_year):
    """New months one after another, one of them with late rows and one with rejected rows only; the
    folders of the build before stay as they are."""
    few = build_from_files(spark, raw_dir, 2025, 4)
    stored = {name: files_below(few, name) for name in TABLES}
    grown = append(few, read_months(spark, raw_dir, 2025, 1, 5))
    june = read_months(spark, raw_dir, 2025, 1, 6)
    grown = append(grown, june.where("tpep_pickup_datetime IS NULL"))
    grown = append(grown, june.where("tpep_pickup_datetime IS NOT NULL"))
    assert (grown.input_rows, grown.rows) == (half_year.input_rows, half_year.rows)
    report = compare_all(spark, half_year.tables(spark), {"grown": grown.tables(spark)}, False)
    assert report.where("NOT equivalent").isEmpty()
    assert as_set(grown.rejects(spark)) == as_set(half_year.rejects(spark))
    assert {name: files_below(few, name) for name in TABLES} == stored
    again = append(grown, read_months(spark, raw_dir, 2025, 1, 1))  # late rows of an old month
    daily, before = (b.table(spark, "daily_metrics").where("date < '2025-02-01'") for b in (again, grown))
    assert daily.agg(F.sum("trip_count")).first()[0] == 2 * before.agg(F.sum("trip_count")).first()[0]


def files_below(build, name):
    return sorted(glob.glob(f"{parts(build.paths[name])[0][0]}/**/*.parquet", recursive=True))


def test_facts_are_read_by_month(spark, half_year):
    stored = spark.read.parquet(half_year.paths["fct_trips"])
    late = since_last_date(half_year.facts(spark), spark.sql("SELECT DATE '2025-05-15' AS date"))
    assert late.count() == 6 + 7
    dates = spark.sql("SELECT DATE '2025-02-01' AS date")
    some = facts_of_dates(half_year.facts(spark), dates)
    assert some.count() == 1
    assert "pickup_month" in partition_filters(some)
    assert "subquery" in partition_filters(late)
    march = between_dates(stored, dt.date(2025, 3, 2), dt.date(2025, 3, 31))
    assert march.count() == 6
    assert "pickup_month" in partition_filters(march)


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_corrected_history_and_revenue_variant(spark, raw_dir):
    january = correct_fares(read_months(spark, raw_dir, 2025, 1))
    raw = january.unionByName(read_months(spark, raw_dir, 2025, 1, 2))
    built = build_tables(raw, zone_rows(spark), variant="fare_tip_tolls")
    total = built.table(spark, "monthly_metrics").agg(F.sum("revenue")).first()[0]
    assert total == 183.0


def test_restatement_replaces_only_its_range(spark, raw_dir, half_year):
    march = read_months(spark, raw_dir, 2025, 1, 3)
    others = read_months(spark, raw_dir, 2025, 2).unionByName(read_months(spark, raw_dir, 2025, 3, 4))
    raw = others.unionByName(correct_fares(march))
    full = build_tables(raw, zone_rows(spark))
    bounds = (dt.date(2025, 3, 1), dt.date(2025, 3, 31))
    done = restate(half_year, raw, zone_rows(spark), *bounds)
    assert as_set(done.table(spark, "daily_metrics")) == as_set(full.table(spark, "daily_metrics"))
    assert as_set(done.table(spark, "monthly_metrics")) == as_set(
        full.table(spark, "monthly_metrics")
    )
    april = (dt.date(2025, 4, 1), dt.date(2025, 4, 30))
    stale = restate(half_year, raw, zone_rows(spark), *april)
    assert as_set(stale.table(spark, "daily_metrics")) == as_set(
        half_year.table(spark, "daily_metrics")
    )


def test_restatement_writes_only_touched_months(spark, raw_dir, half_year):
    """Untouched months stay in the previous build's folders; a chain of restatements reads right."""
    march = read_months(spark, raw_dir, 2025, 1, 3)
    others = read_months(spark, raw_dir, 2025, 2).unionByName(read_months(spark, raw_dir, 2025, 3, 4))
    raw = others.unionByName(correct_fares(march))
    full = build_tables(raw, zone_rows(spark))
    done = restate(half_year, raw, zone_rows(spark), dt.date(2025, 3, 1), dt.date(2025, 3, 31))
    for name in ("stg_trips", "fct_trips"):
        own = parts(done.paths[name])[0][0]
        months = {f.split("pickup_month=")[1].split("/")[0] for f in glob.glob(f"{own}/**/*.parquet", recursive=True) if "pickup_month=2" in f}
        assert months == {"2025-03-01"}
        assert parts(done.paths[name])[1][0] == parts(half_year.paths[name])[0][0]
    for name in TABLES:
        assert as_set(done.table(spark, name)) == as_set(full.table(spark, name))
    assert (done.rows, done.input_rows) == (full.rows, full.input_rows)
    dated = "pickup_date IS NOT NULL"  # rows of no month keep their first version
    assert as_set(done.rejects(spark).where(dated)) == as_set(full.rejects(spark).where(dated))
    # once more, over two months, one of them restated before; then as published views
    twice = restate(done, raw, zone_rows(spark), dt.date(2025, 2, 10), dt.date(2025, 3, 2))
    audit_publish(spark, "restated_test", half_year)
    audit_publish(spark, "restated_test", twice)
    for name in TABLES:
        view = spark.table(f"restated_test.{name}").select(*full.schemas[name].names)
        assert as_set(view) == as_set(full.table(spark, name))
    # another variant, or another dimension, concerns the facts of all months
    other = restate(half_year, raw, zone_rows(spark), dt.date(2025, 3, 1), dt.date(2025, 3, 31), variant="fare_tip_tolls")
    whole = build_tables(raw, zone_rows(spark), variant="fare_tip_tolls")
    assert as_set(other.table(spark, "fct_trips")) == as_set(whole.table(spark, "fct_trips"))


def test_raw_input_is_read_once_and_rejects_stay(spark, raw_dir, half_year):
    raw = read_months(spark, raw_dir, 2025, 6)
    reasons = {r.reject_reason: r.trip_count for r in reject_counts(raw).collect()}
    kept = {r.outcome: r["count"] for r in half_year.classified(spark).groupBy("outcome").count().collect()}
    assert kept == reasons and sum(kept.values()) == half_year.input_rows
    assert half_year.rejects(spark).count() == half_year.rejected_staging_rows


def test_correction_leaves_bad_fares_alone(spark):
    raw = spark.sql(
        "SELECT * FROM VALUES (1, 2.0D), (2, CAST('NaN' AS DOUBLE)), (3, NULL), "
        "(4, CAST('Infinity' AS DOUBLE)) AS t(id, fare_amount)"
    )
    fares = {row.id: row.fare_amount for row in correct_fares(raw).collect()}
    assert fares[1] == 3.0 and fares[2] != fares[2]
    assert fares[3] is None and fares[4] == float("inf")


def test_missing_month_fails_before_writing(spark, raw_dir):
    with pytest.raises(FileNotFoundError):
        build_from_files(spark, raw_dir, 2025, 8)
    with pytest.raises(FileNotFoundError):
        read_zone_csv(spark, f"{raw_dir}/no_such_lookup.csv")


def test_failed_gate_keeps_published_views(spark, raw_dir, half_year):
    audit_publish(spark, "gate_test", half_year)
    raw = read_months(spark, raw_dir, 2025, 7)
    doubled = zone_rows(spark).unionAll(
        spark.sql("SELECT 1L, 'Duplicate', 'Duplicate', 'Duplicate'")
    )
    bad = build_tables(raw, doubled)
    with pytest.raises(QualityError) as caught:
        audit_publish(spark, "gate_test", bad)
    assert caught.value.failures == {"zone_keys": 1}
    assert spark.table("gate_test.fct_trips").count() == 42
    good = build_from_files(spark, raw_dir, 2025, 7)
    audit_publish(spark, "gate_test", good)
    assert spark.table("gate_test.fct_trips").count() == 49
    # The published facts keep the column by which readers skip months, and its comment.
    comments = {c.name: c.description for c in spark.catalog.listColumns("gate_test.fct_trips")}
    assert "folders" in comments["pickup_month"]
    july = spark.table("gate_test.fct_trips").where("pickup_month = DATE '2025-07-01'")
    assert "pickup_month" in re.search(
        r"PartitionFilters: \[([^\]]*)", july._jdf.queryExecution().executedPlan().toString()
    ).group(1)


def test_views_switch_together_or_not_at_all(spark, raw_dir, half_year, monkeypatch):
    point_views(spark, "switch_test", half_year.paths)
    before = as_set(environment_checksums(spark, "switch_test", list(TABLES)))
    later = build_from_files(spark, raw_dir, 2025, 7)
    staged, stage_view = [], publish._stage_view

    def fails_halfway(session, database, name, *rest):
        if len(staged) == 3:
            raise RuntimeError("lost")
        staged.append(name)
        stage_view(session, database, name, *rest)

    monkeypatch.setattr(publish, "_stage_view", fails_halfway)
    with pytest.raises(RuntimeError):
        point_views(spark, "switch_test", later.paths)
    assert as_set(environment_checksums(spark, "switch_test", list(TABLES))) == before
    monkeypatch.setattr(publish, "_stage_view", stage_view)
    point_views(spark, "switch_test", later.paths)
    counts = {name: spark.table(f"switch_test.{name}").count() for name in TABLES}
    assert counts == later.rows
    scans = spark.table("switch_test.fct_trips")._jdf.queryExecution().executedPlan().toString()
    assert scans.count("FileScan") == 1


@pytest.mark.parametrize("lines", ["a,b,c,d\n1,x,y,z", "", "1,x,y,z\n1,x,y,z", "x,x,y,z"])
def test_bad_lookup_is_refused_before_writing(spark, raw_dir, tmp_path, monkeypatch, lines):
    for month in range(1, 3):
        name = f"yellow_tripdata_2025-{month:02d}.parquet"
        (tmp_path / name).symlink_to(f"{raw_dir}/{name}")
    head = "" if lines.startswith("a,") else "LocationID,Borough,Zone,service_zone\n"
    (tmp_path / "taxi_zone_lookup.csv").write_text(head + lines)
    monkeypatch.setattr("tripledger.plans.build.write_table", lambda *a: pytest.fail("written"))
    with pytest.raises(ValueError):
        build_from_files(spark, str(tmp_path), 2025, 2)


def test_development_copy_leaves_production_alone(spark, raw_dir, half_year):
    point_views(spark, "env_prod", half_year.paths)
    before = as_set(environment_checksums(spark, "env_prod", list(TABLES)))
    raw = read_months(spark, raw_dir, 2025, 6)
    zones = read_zone_csv(spark, f"{raw_dir}/taxi_zone_lookup.csv")
    trial = build_tables(raw, zones, fare_offset=1.0, reuse=half_year)
    point_views(spark, "env_dev", {**half_year.paths, "daily_metrics": trial.paths["daily_metrics"]})
    assert as_set(environment_checksums(spark, "env_prod", list(TABLES))) == before
    both = (
        spark.table("env_dev.daily_metrics")
        .select("date", F.col("average_fare").alias("dev"))
        .join(spark.table("env_prod.daily_metrics"), "date")
    )
    assert both.where("dev = average_fare + 1.0").count() == 12
    # Months come from sums, so the shifted display mean does not reach them.
    assert as_set(trial.table(spark, "monthly_metrics")) == as_set(
        half_year.table(spark, "monthly_metrics")
    )
