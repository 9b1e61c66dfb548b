"""Measurement records: validation, summary, pivots, run status."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripledger.functions.numeric import is_finite
from tripledger.operators.groups import group_completeness, uniform_within_group
from tripledger.operators.metrics import with_category_rank
from tripledger.sources.sinks import read_json

# The change scenarios, in display order.
SCENARIOS = (
    "initial_build",
    "no_change",
    "new_data",
    "historical_backfill",
    "business_logic_change",
    "development_environment",
)

# The record layout.
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("implementation", T.StringType()),
        T.StructField("scenario", T.StringType()),
        T.StructField("dataset_kind", T.StringType()),
        T.StructField("dataset_months", T.LongType()),
        T.StructField("dataset_year", T.LongType()),
        T.StructField("start_month", T.LongType()),
        T.StructField("input_rows", T.LongType()),
        T.StructField("output_rows", T.MapType(T.StringType(), T.LongType())),
        T.StructField("execution_seconds", T.DoubleType()),
        T.StructField("models_executed", T.ArrayType(T.StringType())),
        T.StructField("rows_processed", T.LongType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("database_size_mb", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("exit_code", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("equivalent", T.BooleanType()),
    ]
)
SUMMARY_COLUMNS = (
    "scenario",
    "implementation",
    "dataset_months",
    "input_rows",
    "execution_seconds",
    "database_size_mb",
    "strategy",
)
# Fields that agree in a whole run, and in a scenario.
RUN_FIELDS = ("run_id", "dataset_kind", "dataset_year", "start_month")
SCENARIO_FIELDS = ("dataset_months", "input_rows", "output_rows")


class InvalidRecords(ValueError):
    """Raised when a set of records fails validation."""


def classify_records(
    records: DataFrame, members: Sequence[str], scenarios: Sequence[str] | None = None
) -> DataFrame:
    """Add ``reject_reason``: the first rule a record breaks, NULL for valid ones."""

    def measure(name: str):
        return is_finite(F.col(name)) & (F.col(name) >= 0)

    verified = (F.col("status") == "verified") & F.col("equivalent") & (F.col("exit_code") == 0)
    rules = [("not_verified", verified)]
    if scenarios is not None:
        rules.append(("unknown_scenario", F.col("scenario").isin(list(scenarios))))
    rules += [
        ("unknown_member", F.col("implementation").isin(list(members))),
        ("invalid_seconds", measure("execution_seconds")),
        ("invalid_size", measure("database_size_mb")),
        ("missing_counts", F.size("output_rows") > 0),
    ]
    reason = F.lit(None).cast("string")
    for name, good in reversed(rules):
        reason = F.when(~F.coalesce(good, F.lit(False)), name).otherwise(reason)
    return records.withColumn("reject_reason", reason)


def set_problems(records: DataFrame, members: Sequence[str]) -> DataFrame:
    """Problems of a record set as a whole, as (scenario, problem, detail): members a scenario
    lacks or repeats, fields that differ within a scenario, run fields that differ or are
    missing (scenario NULL)."""
    members_off = group_completeness(records, ["scenario"], "implementation", members).select(
        "scenario",
        F.when(F.col("occurrences") == 0, "missing_member")
        .otherwise("surplus_member")
        .alias("problem"),
        F.col("member").alias("detail"),
    )
    fields_off = uniform_within_group(records, ["scenario"], SCENARIO_FIELDS).select(
        "scenario", F.lit("mixed_scenario_field"), "field"
    )
    run_off = uniform_within_group(records, [], RUN_FIELDS, allow_null=False).select(
        F.lit(None).cast("string"), F.lit("mixed_run_field"), "field"
    )
    return members_off.unionAll(fields_off).unionAll(run_off)


def load_measurements(
    spark: SparkSession,
    path: str,
    members: Sequence[str],
    scenarios: Sequence[str] = SCENARIOS,
    array: bool = True,
) -> DataFrame:
    """Read records and accept them as a whole or raise. By default each file is one JSON list,
    which one task reads; ``array=False`` reads one record per line, for files of any size."""
    records = read_json(spark, path, RECORD_SCHEMA, array)
    if records.isEmpty():
        raise InvalidRecords("no records")
    reasons = classify_records(records, members, scenarios).where("reject_reason IS NOT NULL")
    found = reasons.groupBy("reject_reason").count().collect()
    if found:
        raise InvalidRecords(f"rejected records: {dict(map(tuple, found))}")
    problem = set_problems(records, members).first()
    if problem:
        raise InvalidRecords(f"inconsistent record set, for example {problem.asDict()}")
    return in_display_order(records, members, scenarios)


def in_display_order(
    records: DataFrame, members: Sequence[str], scenarios: Sequence[str] = SCENARIOS
) -> DataFrame:
    """Sort by scenario, then by member, in their custom orders."""
    ranked = with_category_rank(records, "scenario", scenarios, "_scenario")
    ranked = with_category_rank(ranked, "implementation", members, "_member")
    return ranked.orderBy("_scenario", "_member").drop("_scenario", "_member")


def summary(records: DataFrame) -> DataFrame:
    """The seven published columns; others are ignored."""
    return records.select(*SUMMARY_COLUMNS)


def executed_steps(runs: DataFrame, steps: str, kind: str = "model.") -> DataFrame:
    """Names of the successful steps of one kind, from an array of (unique_id, status). The
    name is the last dotted part of the id."""
    exploded = runs.select(*(c for c in runs.columns if c != steps), F.inline(steps))
    done = exploded.where(F.col("unique_id").startswith(kind) & (F.col("status") == "success"))
    name = F.element_at(F.split("unique_id", r"\."), -1)
    return done.withColumn("step", name).drop("unique_id", "status")


def run_status(runs: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Add ``equivalent`` and ``status`` to runs: ``failed`` for a non-zero exit code, else
    ``built`` while there is no verdict, else ``verified`` or ``invalid``.

    ``verdicts`` has one boolean ``passed`` per finding (table comparison, unchanged inputs);
    a run needs all of them.
    """
    runs = runs.drop("equivalent", "status")
    by_run = verdicts.groupBy(key).agg(F.bool_and("passed").alias("equivalent"))
    status = (
        F.when(F.col("exit_code") != 0, "failed")
        .when(F.col("equivalent").isNull(), "built")
        .when(F.col("equivalent"), "verified")
        .otherwise("invalid")
    )
    return runs.join(by_run, key, "left").withColumn("status", status)

