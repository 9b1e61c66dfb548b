"""Monthly trip files whose schemas drift."""

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.contract import MONTH_FILE, REQUIRED_TRIP_COLUMNS
from tripledger.sources.files import parquet_layouts


def month_paths(
    raw_dir: str, year: int, months: int, start_month: int = 1, pattern: str = MONTH_FILE
) -> list[str]:
    """Paths of consecutive monthly files within one year. Never a glob: a file that happens
    to lie in the folder but was not selected is not read."""
    if not 1 <= year <= 9999:
        raise ValueError(f"year out of range: {year}")
    if not 1 <= start_month <= 12 or not 1 <= months <= 13 - start_month:
        raise ValueError("select 1 to 12 consecutive months within one year")
    names = (
        pattern.format(year=year, month=month) for month in range(start_month, start_month + months)
    )
    return [f"{raw_dir.rstrip('/')}/{name}" for name in names]


@contextmanager
def path_must_exist(path: str) -> Iterator[None]:
    """Turn Spark's error for a missing path into ``FileNotFoundError``."""
    try:
        yield
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise


def read_union_by_name(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Read Parquet files as one table, matching columns by name.

    Columns a file lacks are NULL, numeric types that differ between files are widened, and
    names differing only in case are one column; files within one folder may differ, too. Files with
    equal schemas share one scan, so the plan grows with the number of schemas and not with the
    number of files. One job reads the footers of all files. A missing path raises before anything
    is read or written.
    """
    if not paths:
        raise ValueError("no input paths given")
    with path_must_exist(", ".join(paths)):
        layouts = parquet_layouts(spark, paths)
    if layouts is None:
        kinds = {path: [path] for path in paths}  # Spark takes one footer of each path
    else:
        kinds = {path: [] for path in paths}
        for row in layouts.where("root IS NOT NULL").select("root", "layout").distinct().collect():
            kinds[row.root].append(row.layout)
    groups: dict[str, list[str]] = {}
    alone, known = [], {}
    for path, found in kinds.items():
        if len(found) > 1:
            alone += _by_layout(spark, path, layouts)
            continue
        # paths of a layout that was met before need no look of their own
        layout = found[0] if found else path
        if layout not in known:
            known[layout] = spark.read.parquet(path).schema.json()
        groups.setdefault(known[layout], []).append(path)
    scans = [spark.read.parquet(*members) for members in groups.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*scans, *alone])


def _by_layout(spark: SparkSession, folder: str, layouts: DataFrame) -> list[DataFrame]:
    """A scan for each layout that the files of a folder have."""
    files = layouts.where(F.col("root") == folder).groupBy("layout").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [spark.read.option("basePath", folder).parquet(*row.paths) for row in files.orderBy("layout").collect()]


def read_months(
    spark: SparkSession,
    raw_dir: str,
    year: int,
    months: int,
    start_month: int = 1,
    pattern: str = MONTH_FILE,
) -> DataFrame:
    """The selected monthly trip files as one table."""
    trips = read_union_by_name(spark, month_paths(raw_dir, year, months, start_month, pattern))
    missing = missing_columns(trips, REQUIRED_TRIP_COLUMNS)
    if missing:
        raise ValueError(f"missing trip columns: {missing}")
    return trips


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that a table lacks; names compare without case, as Spark does."""
    present = {name.lower() for name in df.columns}
    return [name for name in required if name.lower() not in present]


def month_drift(
    spark: SparkSession,
    raw_dir: str,
    year: int,
    months: int,
    start_month: int = 1,
    pattern: str = MONTH_FILE,
) -> DataFrame:
    """Rows per (file month, event month): a file's month does not bound its event dates."""
    scans = []
    for offset in range(months):
        month = start_month + offset
        path = month_paths(raw_dir, year, 1, month, pattern)
        scans.append(
            read_union_by_name(spark, path).select(
                F.make_date(F.lit(year), F.lit(month), F.lit(1)).alias("file_month"),
                F.trunc(F.col("tpep_pickup_datetime").cast("date"), "MM").alias("event_month"),
            )
        )
    rows = reduce(DataFrame.unionAll, scans)
    return rows.groupBy("file_month", "event_month").agg(F.count(F.lit(1)).alias("trip_count"))
