import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from suite.session import local_session  # noqa: E402
from tripledger.sources import fixture  # noqa: E402
from tripledger.sources.sinks import write_csv, write_table  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session("tests", folder=str(tmp_path_factory.mktemp("spark")))


@pytest.fixture(scope="session")
def raw_dir(spark, tmp_path_factory):
    """Seven monthly files of sixteen cases each, and the zone lookup."""
    folder = str(tmp_path_factory.mktemp("raw"))
    for month in range(1, 8):
        cases = fixture.case_matrix(fixture.month_rows(spark, 2025, 1, month))
        rows = cases.select(*fixture.RAW_TRIP_SCHEMA.names)
        write_table(rows, f"{folder}/yellow_tripdata_2025-{month:02d}.parquet")
    write_csv(fixture.zone_rows(spark).coalesce(1), f"{folder}/taxi_zone_lookup.csv")
    return folder


def as_set(df):
    """Rows as a sorted list of tuples, for comparing small results."""
    return sorted(map(tuple, df.collect()), key=repr)
