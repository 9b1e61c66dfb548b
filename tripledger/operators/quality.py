"""Table quality checks. All return rows, so that callers may report, gate or quarantine."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripledger.contract import Bounds
from tripledger.functions.numeric import failures, is_finite
from tripledger.operators.facts import with_zone_flags
from tripledger.operators.joins import flag_unknown, known_ids, lookup_join


class QualityError(ValueError):
    """Raised by ``gate``; ``failures`` maps each failed check to its count."""

    def __init__(self, failed: dict[str, int]):
        super().__init__(f"quality checks failed: {failed}")
        self.failures = failed


def _otherwise_true(condition: Column) -> Column:
    """A NULL condition counts as broken."""
    return F.coalesce(condition, F.lit(True))


def out_of_range(value: Column, low: float, high: float | None = None) -> Column:
    """NULL, non-finite or outside [low, high]."""
    inside = value >= low if high is None else value.between(low, high)
    return _otherwise_true(~(is_finite(value) & inside))


def out_of_order(first: Column, second: Column) -> Column:
    """Either is NULL, or the second precedes the first."""
    return _otherwise_true(second < first)


def trip_rules(bounds: Bounds = Bounds()) -> dict[str, Column]:
    """Row conditions that mark a bad fact, by check name."""
    return {
        "timestamps": out_of_order(F.col("pickup_datetime"), F.col("dropoff_datetime")),
        "distance": out_of_range(F.col("trip_distance"), 0.0),
        "total_amount": out_of_range(F.col("total_amount"), 0.0, bounds.max_total),
        "duration": _otherwise_true(
            ~F.col("trip_duration_minutes").between(0.0, bounds.max_minutes)
        ),
    }


def _as_rows(counts: DataFrame, label: str, value: str) -> DataFrame:
    """One-row table of counts to (label, value) rows."""
    return counts.unpivot([], counts.columns, label, value)


def conservation(fct: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Per part table: how far its ``trip_count`` total is from the number of facts. An empty
    part totals zero."""
    total = fct.agg(*(F.count(F.lit(1)).alias(name) for name in parts))
    return _net(_as_rows(total, "check_name", "failures"), parts)


def _net(counts: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Subtract the parts' totals from the counts of the same name, without a cross join."""
    spent = [
        part.agg((-F.coalesce(F.sum("trip_count"), F.lit(0))).alias("n")).select(
            F.lit(name).alias("check_name"), "n"
        )
        for name, part in parts.items()
    ]
    signed = reduce(DataFrame.unionAll, spent, counts)
    return signed.groupBy("check_name").agg(F.abs(F.sum("failures")).alias("failures"))


def quality_report(
    dim: DataFrame,
    fct: DataFrame,
    daily: DataFrame,
    zone: DataFrame,
    monthly: DataFrame,
    bounds: Bounds = Bounds(),
) -> DataFrame:
    """Nine checks as (check_name, failures). The facts are read once for all of them."""
    parts = {"daily_trip_count": daily, "monthly_trip_count": monthly, "zone_trip_count": zone}
    unknown = F.col("pickup_unknown") | F.col("dropoff_unknown")
    checks = {**trip_rules(bounds), "zone_references": unknown}
    counts = with_zone_flags(fct, dim).agg(
        *(failures(bad).alias(name) for name, bad in checks.items()),
        *(F.count(F.lit(1)).alias(name) for name in parts),
    )
    surplus = dim.agg((F.count(F.lit(1)) - F.countDistinct("zone_id")).alias("zone_keys"))
    rows = _as_rows(counts, "check_name", "failures").unionAll(
        _as_rows(surplus, "check_name", "failures")
    )
    return _net(rows, parts)


def gate(report: DataFrame) -> None:
    """Raise if any check of a report has failures."""
    failed = {row.check_name: row.failures for row in report.where("failures <> 0").collect()}
    if failed:
        raise QualityError(failed)


def count_failures(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break each named check, as (check_name, failures), from one pass."""
    counts = df.agg(*(failures(bad).alias(name) for name, bad in checks.items()))
    return _as_rows(counts, "check_name", "failures")


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per column, from one pass."""
    counts = df.agg(*(failures(F.col(name).isNull()).alias(name) for name in columns))
    return _as_rows(counts, "column_name", "failures")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys without NULLs that occur more than once, with their number of rows."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where("occurrences > 1")
    )


def surplus_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond one per distinct key; a NULL key is surplus as well."""
    return df.agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("failures"))


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent."""
    ids = known_ids(parent, key)
    listed = ids.select(F.col(key).alias("_parent_key"))
    present = child.where(F.col(foreign_key).isNotNull())
    return lookup_join(present, listed, [(foreign_key, "_parent_key")], "left_anti")


def bad_references(fct: DataFrame, dim: DataFrame) -> DataFrame:
    """Facts with a pickup or dropoff zone that does not exist. A NULL id does not exist."""
    flagged = with_zone_flags(fct, dim)
    return flagged.where("pickup_unknown OR dropoff_unknown").select(*fct.columns)


def with_not_in_flags(fct: DataFrame, dim: DataFrame) -> DataFrame:
    """Add ``pickup_not_in`` and ``dropoff_not_in``, the three-valued result of SQL's
    ``id NOT IN (SELECT zone_id FROM dim)``.

    No match is TRUE only if neither the id nor any zone id is NULL, else it is NULL; an empty
    dimension makes it TRUE for every id. Written as existence flags so that the join stays a
    hash join; NOT IN under OR would compare every fact with every zone.
    """
    ids = known_ids(dim, "zone_id")
    has_null = dim.agg(F.coalesce(F.bool_or(F.col("zone_id").isNull()), F.lit(False))).scalar()
    is_empty = dim.agg(F.count(F.lit(1)) == 0).scalar()
    for role in ("pickup", "dropoff"):
        column, flag = f"{role}_zone_id", f"{role}_not_in"
        fct = flag_unknown(fct, ids, "zone_id", column, flag)
        verdict = (
            F.when(~F.col(flag), False)
            .when(is_empty, True)
            .when(~has_null & F.col(column).isNotNull(), True)
        )
        fct = fct.withColumn(flag, verdict)
    return fct


def not_in_references(fct: DataFrame, dim: DataFrame) -> DataFrame:
    """Facts with a zone id NOT IN the dimension, with SQL's treatment of NULL."""
    flagged = with_not_in_flags(fct, dim)
    return flagged.where("pickup_not_in OR dropoff_not_in").select(*fct.columns)


def audit_rows(fct: DataFrame, dim: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """The facts that break any rule: the rows for a quarantine table."""
    flagged = with_not_in_flags(fct, dim)
    bad = reduce(Column.__or__, trip_rules(bounds).values())
    return flagged.where(bad | F.col("pickup_not_in") | F.col("dropoff_not_in")).select(
        *fct.columns
    )


def nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinite values per double column."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    counts = df.agg(*(failures(~is_finite(F.col(name))).alias(name) for name in names))
    return _as_rows(counts, "column_name", "failures")
