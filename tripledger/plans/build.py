"""Build the six tables from raw input."""

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from tripledger.contract import MONTH_FILE, TABLES, ZONE_FILE, Bounds
from tripledger.operators.facts import PARTITION, between_dates, dim_zones, fct_trips, write_facts
from tripledger.operators.metrics import daily_metrics, monthly_metrics, zone_metrics
from tripledger.operators.quality import quality_report
from tripledger.operators.records import RECORD_SCHEMA
from tripledger.operators.refresh import overwrite_range, refresh_touched
from tripledger.operators.staging import ACCEPTED, OUTCOME, stage, write_classified
from tripledger.sources.files import storage_stats
from tripledger.sources.months import read_months
from tripledger.sources.sinks import write_table
from tripledger.sources.versions import extended, location, parts, read_location, replaced
from tripledger.sources.workdir import fresh_dir
from tripledger.sources.zones import check_zone_lookup, read_zone_csv


MONTH = StructField(PARTITION, DateType())
ACCEPTED_ROWS = f"{OUTCOME} = '{ACCEPTED}'"
#: Storage columns of the tables that are kept by month.
STORAGE = {"stg_trips": [StructField(OUTCOME, StringType()), MONTH], "fct_trips": [MONTH]}


@dataclass
class Build:
    """Stored tables of one build: their locations (see ``sources.versions``), how many rows they
    have. ``trips`` holds all raw rows, typed, with their outcome."""

    paths: dict[str, str]
    rows: dict[str, int] = field(default_factory=dict)
    schemas: dict[str, StructType] = field(default_factory=dict)
    input_rows: int = 0
    trips: str = ""
    variant: str = "fare"

    def _stored(self, spark: SparkSession, name: str) -> DataFrame:
        schema = StructType([*self.schemas[name], *STORAGE.get(name, [])])
        return read_location(spark, self.paths[name], schema)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return self._stored(spark, name).select(*self.schemas[name].names)

    def facts(self, spark: SparkSession) -> DataFrame:
        """The facts with their storage column, by which Spark can skip whole months."""
        return self._stored(spark, "fct_trips")

    def classified(self, spark: SparkSession) -> DataFrame:
        """All raw rows, typed, with ``outcome``: accepted, or the first rule that they break."""
        schema = StructType([*self.schemas["stg_trips"], *STORAGE["stg_trips"]])
        return read_location(spark, self.trips, schema).drop(PARTITION)

    def rejects(self, spark: SparkSession) -> DataFrame:
        """The rows that staging rejected, with their reason in ``outcome``."""
        return self.classified(spark).where(f"{OUTCOME} <> '{ACCEPTED}'")

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {name: self.table(spark, name) for name in TABLES}

    @property
    def rejected_staging_rows(self) -> int:
        return self.input_rows - self.rows["stg_trips"]

    @property
    def rejected_zone_rows(self) -> int:
        return self.rows["stg_trips"] - self.rows["fct_trips"]


def build_tables(
    raw: DataFrame,
    raw_zones: DataFrame,
    bounds: Bounds = Bounds(),
    variant: str = "fare",
    fare_offset: float = 0.0,
    reuse: Build | None = None,
) -> Build:
    """Full rebuild into a new folder; nothing that already exists is touched.

    The raw input is read once: all its rows are stored with their outcome, the accepted ones by
    month. Facts are stored by month too, so that later refreshes read only the months they need. Row
    counts come from the footers of the written files; counters kept while writing would count
    the rows of repeated tasks twice. With ``reuse`` the staged trips and the dimension of an
    earlier build serve again, for a change of logic that does not concern them.
    """
    spark = raw.sparkSession
    done = _new_build(spark)
    done.variant = variant
    if reuse is None:
        _store_trips(spark, done, raw, bounds)
        done.input_rows = done.classified(spark).count()
        _store(spark, done, "dim_zones", dim_zones(raw_zones))
    else:
        for name in ("stg_trips", "dim_zones"):
            done.paths[name], done.rows[name] = reuse.paths[name], reuse.rows[name]
            done.schemas[name] = reuse.schemas[name]
        done.input_rows, done.trips = reuse.input_rows, reuse.trips
    stg, dim = (done.table(spark, name) for name in ("stg_trips", "dim_zones"))
    fct = _store(spark, done, "fct_trips", fct_trips(stg, dim, variant), write_facts)
    _store_metrics(spark, done, fct, daily_metrics(fct, fare_offset))
    return done


def restate(
    previous: Build,
    raw: DataFrame,
    raw_zones: DataFrame,
    start: dt.date,
    end: dt.date,
    bounds: Bounds = Bounds(),
    variant: str = "fare",
) -> Build:
    """Recompute after a correction of the input: staged trips and facts of the months from start
    to end, and of the daily table the dates from start to end (inclusive), also those that
    vanished. Months that are not touched stay where the previous build has them; the small tables
    over all history are written anew. Rejected rows without a pickup date belong to no month and
    keep their first version. Facts of all months are, too, if zones or variant changed.
    """
    spark = raw.sparkSession
    done = _new_build(spark)
    done.variant = variant
    months = f"BETWEEN DATE '{start.replace(day=1)}' AND DATE '{end.replace(day=1)}'"
    touched = f"trunc(pickup_date, 'MM') {months}"
    _store_trips(spark, done, raw, bounds, touched)
    fresh_rows = done.table(spark, "stg_trips")
    done.trips = replaced(done.trips, previous.trips, touched)
    done.paths["stg_trips"] = replaced(done.paths["stg_trips"], previous.paths["stg_trips"], f"{PARTITION} {months}")
    done.rows["stg_trips"] = done.table(spark, "stg_trips").count()
    done.input_rows = done.classified(spark).count()
    dim = _store(spark, done, "dim_zones", dim_zones(raw_zones))
    known = previous.table(spark, "dim_zones")
    same = dim.exceptAll(known).isEmpty() and known.exceptAll(dim).isEmpty()
    if same and variant == previous.variant:
        _store(spark, done, "fct_trips", fct_trips(fresh_rows, dim, variant), write_facts)
        done.paths["fct_trips"] = replaced(done.paths["fct_trips"], previous.paths["fct_trips"], f"{PARTITION} {months}")
        fct = done.table(spark, "fct_trips")
        done.rows["fct_trips"] = fct.count()
    else:
        fct = _store(spark, done, "fct_trips", fct_trips(done.table(spark, "stg_trips"), dim, variant), write_facts)
    restated = daily_metrics(between_dates(done.facts(spark), start, end))
    kept = previous.table(spark, "daily_metrics")
    _store_metrics(spark, done, fct, overwrite_range(kept, restated, "date", start, end))
    return done


def append(previous: Build, raw: DataFrame, bounds: Bounds = Bounds()) -> Build:
    """Add raw rows that arrived after a build, such as the file of a new month, whatever dates they
    have. The result equals a full rebuild from all rows.

    Only the new rows are staged and joined; the new build names the folders of the previous one
    beside its own, so nothing is copied. Of the daily table the dates that occur in the new facts are
    recomputed, from the months that hold them; the small tables over all history are written anew.
    Every addition adds a folder per table: rebuild once there are many.
    """
    spark = raw.sparkSession
    done = _new_build(spark)
    done.variant = previous.variant
    _store_trips(spark, done, raw, bounds)
    done.input_rows = previous.input_rows + done.classified(spark).count()
    added = done.table(spark, "stg_trips")
    done.trips = extended(previous.trips, done.trips)
    name = "dim_zones"
    done.paths[name], done.rows[name], done.schemas[name] = previous.paths[name], previous.rows[name], previous.schemas[name]
    new = _store(spark, done, "fct_trips", fct_trips(added, done.table(spark, name), done.variant), write_facts)
    for name in ("stg_trips", "fct_trips"):
        # a table partitioned by month has no files where it got no rows
        some = done.rows[name] > 0
        done.paths[name] = extended(previous.paths[name], done.paths[name]) if some else previous.paths[name]
        done.rows[name] += previous.rows[name]
    daily = refresh_touched(previous.table(spark, "daily_metrics"), done.facts(spark), new, daily_metrics)
    _store_metrics(spark, done, done.table(spark, "fct_trips"), daily)
    return done


def _new_build(spark: SparkSession) -> Build:
    base = fresh_dir(spark, "build")
    return Build({name: f"{base}/{name}" for name in TABLES})


def _store_trips(spark: SparkSession, build: Build, raw: DataFrame, bounds: Bounds, only: str = "true") -> None:
    folder = build.paths["stg_trips"]
    write_classified(raw, folder, bounds, only)
    build.schemas["stg_trips"] = stage(raw, bounds).schema
    build.trips, build.paths["stg_trips"] = folder, location((folder, [ACCEPTED_ROWS]))
    build.rows["stg_trips"] = build.table(spark, "stg_trips").count()


def _store(
    spark: SparkSession,
    build: Build,
    name: str,
    df: DataFrame,
    write: Callable[[DataFrame, str], None] = write_table,
) -> DataFrame:
    write(df, build.paths[name])
    build.schemas[name] = df.schema
    stored = build.table(spark, name)
    build.rows[name] = stored.count()
    return stored


def _store_metrics(spark: SparkSession, build: Build, fct: DataFrame, daily: DataFrame) -> None:
    stored = _store(spark, build, "daily_metrics", daily)
    _store(spark, build, "zone_metrics", zone_metrics(fct))
    _store(spark, build, "monthly_metrics", monthly_metrics(stored))


def report_for(spark: SparkSession, build: Build, bounds: Bounds = Bounds()) -> DataFrame:
    """The quality report of a stored build."""
    tables = build.tables(spark)
    return quality_report(
        tables["dim_zones"],
        tables["fct_trips"],
        tables["daily_metrics"],
        tables["zone_metrics"],
        tables["monthly_metrics"],
        bounds,
    )


def build_summary(spark: SparkSession, build: Build) -> DataFrame:
    """(measure, row_count): input rows, the rows of each table, and the two kinds of rejects."""
    counts = {
        "input": build.input_rows,
        **build.rows,
        "rejected_staging": build.rejected_staging_rows,
        "rejected_zone": build.rejected_zone_rows,
    }
    return spark.createDataFrame(list(counts.items()), "measure string, row_count bigint")


def run_record(
    spark: SparkSession,
    build: Build,
    run: dict[str, object],
    seconds: float,
    strategy: str,
    executed: Sequence[str] = TABLES,
) -> DataFrame:
    """One measurement record of a finished build, with status ``built`` until ``run_status``
    adds a verdict. ``run`` names the run: run_id, implementation, scenario, dataset_kind,
    dataset_year, dataset_months, start_month."""
    own = {name: parts(where)[0][0] for name, where in build.paths.items()}
    size = storage_stats(spark, own).agg(F.sum("size_mib")).first()[0]
    values = {
        **run,
        "input_rows": build.input_rows,
        "output_rows": build.rows,
        "execution_seconds": seconds,
        "models_executed": list(executed),
        "strategy": strategy,
        "database_size_mb": size,
        "timestamp": dt.datetime.now(dt.UTC).isoformat(),
        "exit_code": 0,
        "status": "built",
    }
    row = tuple(values.get(name) for name in RECORD_SCHEMA.names)
    return spark.createDataFrame([row], RECORD_SCHEMA)


def build_from_files(
    spark: SparkSession,
    raw_dir: str,
    year: int,
    months: int,
    start_month: int = 1,
    bounds: Bounds = Bounds(),
    pattern: str = MONTH_FILE,
    **options,
) -> Build:
    """Full rebuild from the selected monthly files and the zone lookup of a folder. A missing
    month or column, and a lookup that is unreadable, empty or has an id twice or none, raise before
    anything is written."""
    raw = read_months(spark, raw_dir, year, months, start_month, pattern)
    zones = read_zone_csv(spark, f"{raw_dir.rstrip('/')}/{ZONE_FILE}")
    check_zone_lookup(zones)
    return build_tables(raw, zones, bounds, **options)
