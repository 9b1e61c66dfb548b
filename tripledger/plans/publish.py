"""Publishing: consumers read views, and views move only after the checks have passed."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tripledger.contract import COLUMN_COMMENTS, TABLE_COMMENTS, Bounds
from tripledger.operators.compare import content_checksums, database_tables
from tripledger.operators.facts import PARTITION
from tripledger.operators.quality import gate
from tripledger.operators.staging import OUTCOME
from tripledger.plans.build import Build, report_for
from tripledger.sources.versions import parts
from tripledger.sources.workdir import shared_dir


def ensure_database(spark: SparkSession, database: str) -> None:
    """Create the database that holds the views, if it does not exist."""
    location = f"{shared_dir(spark)}/tripledger/{database}.db"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{location}'")


POINTER = "current_build"
#: Storage columns that views do not show.
HIDDEN = {"stg_trips": (OUTCOME, PARTITION)}


def _pointer(build: str, paths: dict[str, str]) -> str:
    text = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    listed = ", ".join(f"{text(name)}, {text(path)}" for name, path in paths.items())
    return f"SELECT '{build}' AS build, {f'map({listed})' if paths else 'CAST(map() AS MAP<STRING, STRING>)'} AS paths"


def point_views(spark: SparkSession, database: str, paths: dict[str, str]) -> None:
    """Point the views of a database at stored tables (their locations, see ``sources.versions``),
    all of them in one step.

    Every view holds the old and the new version of its table, and shows the one that the view
    ``current_build`` names. Spark folds that name into the plan, so only the shown version is
    read. First the views get their new version, which changes nothing to see; then
    ``current_build`` is replaced, which switches all of them. A failure before that step leaves
    everything as it was, and folders that older readers still use stay in place.
    """
    ensure_database(spark, database)
    pointer = f"`{database}`.`{POINTER}`"
    if not spark.catalog.tableExists(f"{database}.{POINTER}"):
        spark.sql(f"CREATE VIEW {pointer} AS {_pointer('', {})}")
    before = spark.table(f"{database}.{POINTER}").first()
    build = uuid4().hex
    for name, path in paths.items():
        _stage_view(spark, database, name, path, build, before.paths.get(name), before.build)
    kept = {**before.paths, **paths}
    for name in set(before.paths) - set(paths):  # tables that stay as they are
        _stage_view(spark, database, name, kept[name], build, kept[name], before.build)
    spark.sql(f"CREATE OR REPLACE VIEW {pointer} AS {_pointer(build, kept)}")


def _stage_view(
    spark: SparkSession, database: str, name: str, new: str, build: str, old: str | None, shown: str
) -> None:
    """Let a view show the new path once the pointer names ``build``, and the old one until then."""
    columns = [c for c in spark.read.parquet(parts(new)[0][0]).columns if c not in HIDDEN.get(name, ())]

    def version(where: str, when: str) -> str:
        current = f"(SELECT build FROM `{database}`.`{POINTER}`) = '{when}'"
        selects = []
        for path, conditions in parts(where):
            have = spark.read.parquet(path).columns
            listed = ", ".join(f"`{c}`" if c in have else f"NULL AS `{c}`" for c in columns)
            selects.append(f"SELECT {listed} FROM parquet.`{path}` WHERE {' AND '.join([current, *conditions])}")
        return " UNION ALL ".join(selects)

    versions = [version(new, build)] + ([version(old, shown)] if old else [])
    comments = COLUMN_COMMENTS.get(name, {})
    named = ", ".join(f"`{c}`" + (f" COMMENT '{comments[c]}'" if c in comments else "") for c in columns)
    spark.sql(
        f"CREATE OR REPLACE VIEW `{database}`.`{name}` ({named}) "
        f"COMMENT '{TABLE_COMMENTS.get(name, '')}' AS {' UNION ALL '.join(versions)}"
    )


def audit_publish(
    spark: SparkSession, database: str, build: Build, bounds: Bounds = Bounds()
) -> DataFrame:
    """Check a stored build and publish it. If a check fails this raises, and the views keep
    showing the previous build. Returns the quality report."""
    report = report_for(spark, build, bounds)
    gate(report)
    point_views(spark, database, build.paths)
    return report


def environment_checksums(spark: SparkSession, database: str, names: list[str]) -> DataFrame:
    """Checksum of each published table, to prove later that an environment did not change."""
    tables = database_tables(spark, database, names)
    return content_checksums({name: df for name, df in tables.items() if df is not None})
