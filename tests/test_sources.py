import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import as_set
from tripledger.contract import RAW_ZONE_SCHEMA
from tripledger.operators.facts import dim_zones
from tripledger.operators.staging import rename_cast, typed_trips
from tripledger.sources import files, months, sinks, workdir, zones
from tripledger.sources.fixture import case_matrix, month_rows


def test_month_paths_name_every_selected_month():
    for start in range(1, 13):
        for count in range(1, 14 - start):
            paths = months.month_paths("/in/", 1987, count, start, "m{month:02d}-{year}")
            assert paths == [f"/in/m{m:02d}-1987" for m in range(start, start + count)]


def test_selections_beyond_a_year_are_refused():
    for start in range(-1, 15):
        for count in range(-1, 15):
            if not (1 <= start <= 12 and count >= 1 and start + count <= 13):
                with pytest.raises(ValueError):
                    months.month_paths("/in", 1987, count, start)
    for year in (-1, 0, 10_000):
        with pytest.raises(ValueError):
            months.month_paths("/in", year, 1)


def test_only_selected_files_are_read(spark, raw_dir):
    assert months.read_months(spark, raw_dir, 2025, 6).count() == 96
    assert months.read_months(spark, raw_dir, 2025, 2, 6).count() == 32


def test_schema_drift(spark, tmp_path):
    spark.sql("SELECT 1L AS id, 5L AS n, 1.5D AS airport_fee").write.parquet(f"{tmp_path}/a")
    spark.sql("SELECT 2L AS id, 2.5D AS n, 2.5D AS Airport_fee, 'x' AS extra").write.parquet(
        f"{tmp_path}/b"
    )
    both = months.read_union_by_name(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert as_set(both.select("id", "n", "airport_fee", "extra")) == [
        (1, 5.0, 1.5, None),
        (2, 2.5, 2.5, "x"),
    ]


def test_drift_within_a_folder(spark, tmp_path):
    spark.sql("SELECT 1L AS id, 5L AS n").write.parquet(f"{tmp_path}/a/day=1")
    spark.sql("SELECT 2L AS id, 2.5D AS n, 'x' AS extra").write.parquet(f"{tmp_path}/a/day=2")
    spark.sql("SELECT 3L AS id, 7L AS n").write.parquet(f"{tmp_path}/b b")
    both = months.read_union_by_name(spark, [f"{tmp_path}/a", f"file:{tmp_path}/b b/"])
    assert as_set(both.select("id", "n", "extra", "day")) == [
        (1, 5.0, None, 1),
        (2, 2.5, "x", 2),
        (3, 7.0, None, None),
    ]


def test_footers_of_many_files_in_one_job(spark, tmp_path):
    kinds = ("id bigint, n bigint", "id bigint, n double, extra string", "id bigint")
    for i in range(300):
        fields = {"id": [i], "n": [i * 1.0 if i % 3 else i], "extra": ["x"]}
        names = [f.split()[0] for f in kinds[i % 3].split(", ")]
        pq.write_table(pa.table({name: fields[name] for name in names}), f"{tmp_path}/f{i}.parquet")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("footers", "read")
    try:
        df = months.read_union_by_name(spark, [f"{tmp_path}/f{i}.parquet" for i in range(300)])
        # a listing, a job (with its shuffle) for the footers, one for each schema and one for each scan
        assert len(tracker.getJobIdsForGroup("footers")) <= 12
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert df.count() == 300 and df.where("extra = 'x'").count() == 100
    with pytest.raises(FileNotFoundError):
        months.read_union_by_name(spark, [f"{tmp_path}/f1.parquet", f"{tmp_path}/none.parquet"])


def test_equal_schemas_share_a_scan(spark, raw_dir):
    plan = months.read_months(spark, raw_dir, 2025, 6)._jdf.queryExecution().optimizedPlan()
    assert "Union" not in plan.toString()


def test_month_drift(spark, tmp_path):
    trips = case_matrix(month_rows(spark, 2025, 1, 3)).drop("month", "row_index", "case_name")
    trips.write.parquet(f"{tmp_path}/yellow_tripdata_2025-04.parquet")
    drift = as_set(months.month_drift(spark, str(tmp_path), 2025, 1, 4))
    assert sorted(n for _, _, n in drift) == [1, 15]


def test_ids_stored_as_double_round(spark):
    raw = case_matrix(month_rows(spark, 2025, 1)).withColumn("PULocationID", F.lit(1.6))
    assert rename_cast(raw).select("pickup_zone_id").distinct().collect()[0][0] == 2


def test_malformed_value_fails(spark):
    raw = case_matrix(month_rows(spark, 2025, 1)).withColumn("PULocationID", F.lit("abc"))
    with pytest.raises(PySparkException):
        rename_cast(raw).collect()


def test_duration_ignores_clock_changes(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        raw = (
            case_matrix(month_rows(spark, 2025, 1))
            .where("case_name = 'card'")
            .withColumn("tpep_pickup_datetime", F.expr("TIMESTAMP_NTZ '2025-03-09 01:30:00'"))
            .withColumn("tpep_dropoff_datetime", F.expr("TIMESTAMP_NTZ '2025-03-09 02:30:00.5'"))
        )
        row = typed_trips(raw).first()
        assert row.trip_duration_minutes == 3600.5 / 60
        assert row.pickup_hour == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_zone_csv(spark, raw_dir, tmp_path):
    lookup = zones.read_zone_csv(spark, f"{raw_dir}/taxi_zone_lookup.csv")
    zones.check_zone_lookup(lookup)
    assert dim_zones(lookup).where("zone_id = 1").first()[1:] == (
        "Synthetic Borough",
        "Synthetic Airport",
        "Airports",
    )
    page = tmp_path / "page.csv"
    page.write_text("<html>\nError\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        zones.read_zone_csv(spark, str(page)).collect()
    with pytest.raises(ValueError):
        zones.check_zone_lookup(lookup.unionAll(lookup))
    with pytest.raises(ValueError):
        zones.check_zone_lookup(spark.createDataFrame([], RAW_ZONE_SCHEMA))


def test_zone_csv_keeps_text_and_nulls(spark, tmp_path):
    source = tmp_path / "zones.csv"
    source.write_bytes("﻿LocationID,Borough,Zone,service_zone\n264,N/A,,Z\n".encode())
    assert as_set(zones.read_zone_csv(spark, str(source))) == [(264, "N/A", None, "Z")]


def test_manifests_and_changes(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/a")
    before = workdir.materialize(files.file_manifest(spark, [f"{tmp_path}/a/*.parquet"]), "m")
    row = before.first()
    assert row.bytes > 0 and len(row.sha256) == 64
    spark.range(3).coalesce(1).write.mode("append").parquet(f"{tmp_path}/a")
    after = files.file_manifest(spark, [f"{tmp_path}/a/*.parquet"])
    statuses = sorted(row.status for row in files.changed_files(before, after).collect())
    assert statuses == ["added", "unchanged"]
    changed = files.changed_files(before, before.withColumn("sha256", F.lit("x")))
    assert [row.status for row in changed.collect()] == ["changed"]
    assert [r.status for r in files.changed_files(before, before.limit(0)).collect()] == ["removed"]
    contents = files.table_manifest(spark.read.parquet(f"{tmp_path}/a"))
    assert sorted(row.row_count for row in contents.collect()) == [3, 10]


def test_manifests_of_any_size(spark, tmp_path, monkeypatch):
    """The true hash, and ranges that go to several tasks; all ways of reading give the same."""
    sizes = {"one": 1, "even": 3000, "odd one": 3001, "small": 1000, "large": 900_000}
    want, ranges = set(), set()
    for name, size in sizes.items():
        data = random.Random(size).randbytes(size)
        (tmp_path / name).write_bytes(data)
        parts = [hashlib.sha256(data[i : i + 1000]).hexdigest() for i in range(0, size, 1000)]
        want.add((name, size, hashlib.sha256(data).hexdigest()))
        ranges.add((name, size, hashlib.sha256("".join(parts).encode()).hexdigest()))
    monkeypatch.setattr(files, "RANGE", 1000)
    for stores in (files.ARROW_STORES, ()):
        monkeypatch.setattr(files, "ARROW_STORES", stores)
        for wanted, manifest in ((want, files.file_manifest), (ranges, lambda *a: files.range_manifest(*a, piece=1000))):
            got = [tuple(r) for r in manifest(spark, [str(tmp_path)]).collect()]
            assert {(path.rsplit("/", 1)[1], size, digest) for path, size, digest in got} == wanted
            assert len(got) == len(wanted)


def test_manifests_beyond_two_gib(spark, tmp_path):
    """A file that no value of Spark can hold; sparse, so it takes no room."""
    size = 2**31 + 5
    with open(tmp_path / "big", "wb") as f:
        f.truncate(size)
    with open(tmp_path / "big", "rb") as f:
        whole = hashlib.file_digest(f, "sha256").hexdigest()
    assert as_set(files.file_manifest(spark, [str(tmp_path)]).select("bytes", "sha256")) == [(size, whole)]
    full, last = (hashlib.sha256(bytes(n)).hexdigest() for n in (files.RANGE, size % files.RANGE))
    want = hashlib.sha256((full * (size // files.RANGE) + last).encode()).hexdigest()
    assert as_set(files.range_manifest(spark, [str(tmp_path)]).select("bytes", "ranges_sha256")) == [(size, want)]


def test_storage_stats(spark, raw_dir):
    stats = files.storage_stats(spark, {"raw": raw_dir}).first()
    assert stats.files >= 7 and stats.size_mib > 0


def test_csv_and_json_round_trip(spark, tmp_path):
    df = spark.sql(
        "SELECT 1 AS id, map('a', 2L) AS counts, array('x', NULL) AS names, "
        "CAST(NULL AS STRING) AS gone, 'say \"hi\", then' AS text"
    )
    sinks.write_csv(df, f"{tmp_path}/csv")
    back = sinks.read_csv(spark, f"{tmp_path}/csv", sinks.nested_as_json(df).schema)
    assert as_set(back) == [(1, '{"a":2}', '["x",null]', None, 'say "hi", then')]
    sinks.write_json(df, f"{tmp_path}/json")
    assert sinks.read_json(spark, f"{tmp_path}/json", df.schema).collect() == df.collect()


def test_comments_and_schema(spark):
    df = sinks.with_comments(spark.sql("SELECT 1L AS id, 'a' AS name"), {"id": "row number"})
    assert df.schema["id"].metadata == {"comment": "row number"}
    assert sinks.table_schema(df) == [("id", "bigint"), ("name", "string")]


def test_case_matrix_is_the_fixture(spark):
    cases = case_matrix(month_rows(spark, 2025, 7))
    assert cases.count() == 112
    row = cases.where("case_name = 'month_boundary' AND month(month) = 2").first()
    assert (row.row_index, row.fare_amount, row.total_amount) == (15, 12.0, 19.0)
    assert str(row.tpep_dropoff_datetime) == "2025-02-01 00:15:00"
