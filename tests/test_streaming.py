from functools import partial

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from tripledger.contract import RAW_TRIP_SCHEMA
from tripledger.operators.facts import dim_zones, fct_trips
from tripledger.operators.metrics import daily_metrics
from tripledger.operators.staging import reject_counts, stage
from tripledger.sources.fixture import case_matrix, month_rows, zone_rows
from tripledger.streaming import ingest


@pytest.fixture()
def dim(spark):
    return dim_zones(zone_rows(spark))


def drop(spark, inbox, name, months, cases="TRUE"):
    rows = case_matrix(months).where(cases).select(*RAW_TRIP_SCHEMA.names)
    rows.coalesce(1).write.parquet(f"{inbox}/{name}")


def test_each_run_takes_only_new_files_and_late_rows_count(spark, dim, tmp_path):
    inbox, target = str(tmp_path / "inbox"), str(tmp_path / "target")
    columns = daily_metrics(fct_trips(stage(case_matrix(month_rows(spark, 2025, 1))), dim)).columns

    def run():
        stream = ingest.read_drops(spark, inbox, RAW_TRIP_SCHEMA)
        ingest.stream_ingest(stream, dim, target).awaitTermination()
        return ingest.latest(spark, f"{target}/daily", "date").select(*columns)

    drop(spark, inbox, "first", month_rows(spark, 2025, 3), "case_name <> 'cash'")
    assert run().count() == 6
    # An older month's late rows, together with rows that are all rejected.
    drop(spark, inbox, "second", month_rows(spark, 2025, 3), "case_name = 'cash'")
    everything = case_matrix(month_rows(spark, 2025, 3))
    expected = daily_metrics(fct_trips(stage(everything), dim))
    assert as_set(run()) == as_set(expected)
    touched = spark.read.parquet(f"{target}/daily").where("batch = 1")
    assert touched.count() == 3
    drop(spark, inbox, "third", month_rows(spark, 2025, 3), "case_name = 'null_pickup'")
    assert as_set(run()) == as_set(expected)


def test_repeated_batch_changes_nothing(spark, dim, tmp_path):
    inbox, target = str(tmp_path / "inbox"), str(tmp_path / "target")
    drop(spark, inbox, "first", month_rows(spark, 2025, 2))
    for attempt in ("a", "b"):
        # A new checkpoint makes the same batch arrive again.
        stream = ingest.read_drops(spark, inbox, RAW_TRIP_SCHEMA)
        query = ingest.stream_ingest(stream, dim, target, checkpoint=str(tmp_path / attempt))
        query.awaitTermination()
    assert ingest.latest(spark, f"{target}/daily", "date").agg(F.sum("trip_count")).first()[0] == 14


def test_batches_of_equal_work(spark, dim, tmp_path, monkeypatch):
    """A batch reads one version of the months it touches, however many batches there were, and may
    be repeated."""
    inbox, read = str(tmp_path / "inbox"), []
    versions = ingest._versions

    def counted(*args):
        found = versions(*args)
        read.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(ingest, "_versions", counted)
    months = month_rows(spark, 2025, 2).persist()
    for i in range(6):
        drop(spark, inbox, f"drop{i}", months)
    everything = spark.read.schema(RAW_TRIP_SCHEMA).option("recursiveFileLookup", True).parquet(inbox)
    expected = daily_metrics(fct_trips(stage(everything), dim))
    for attempt in ("a", "b"):
        # A new checkpoint makes the same batches arrive again.
        monkeypatch.setattr(ingest, "_run", partial(_elsewhere, ingest_run, str(tmp_path / attempt)))
        stream = ingest.read_drops(spark, inbox, RAW_TRIP_SCHEMA, files_per_batch=1)
        ingest.stream_daily(stream, dim, str(tmp_path / "out")).awaitTermination()
        daily = ingest.latest(spark, f"{tmp_path}/out/daily_state", "date").select(*expected.columns)
        assert as_set(daily) == as_set(expected)
    touched = everything.select(F.trunc("tpep_pickup_datetime", "MM")).distinct().count()
    assert len(read) == 10 and max(read) <= touched


ingest_run = ingest._run


def _elsewhere(run, checkpoint, stream, mode, _, sink):
    return run(stream, mode, checkpoint, sink)


def test_streaming_state(spark, dim, tmp_path):
    inbox = str(tmp_path / "inbox")
    drop(spark, inbox, "first", month_rows(spark, 2025, 2))
    drop(spark, inbox, "second", month_rows(spark, 2025, 2))
    both = case_matrix(month_rows(spark, 2025, 2))
    both = both.unionAll(both)

    def trips():
        return ingest.read_drops(spark, inbox, RAW_TRIP_SCHEMA, files_per_batch=1)

    ingest.stream_rejects(trips(), str(tmp_path / "r")).awaitTermination()
    rejects = ingest.latest(spark, f"{tmp_path}/r/rejects", "reject_reason")
    assert as_set(rejects) == as_set(reject_counts(both))
    ingest.stream_daily(trips(), dim, str(tmp_path / "d")).awaitTermination()
    expected = daily_metrics(fct_trips(stage(both), dim))
    daily = ingest.latest(spark, f"{tmp_path}/d/daily_state", "date").select(*expected.columns)
    assert as_set(daily) == as_set(expected)
