"""Properties that matter on large data: exact sums, skew-proof joins, plan shapes."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from suite.queries import QUERIES, _monthly_fct
from tests.conftest import as_set
from tripledger.functions.numeric import LIMBS, exact_sums, mean_of, merge_sums, partial_sums
from tripledger.operators import joins, metrics, refresh
from tripledger.operators.staging import stage
from tripledger.sources import workdir
from tripledger.sources.fixture import RAW_TRIP_SCHEMA, ZONES, zone_rows
from tripledger.sources.months import read_months
from tripledger.sources.sinks import salts, spread, with_salt, write_table
from tripledger.sources.workdir import materialize

SF = "/root/testdata/sf0.001"


def sums(df):
    return {r.g: r.x for r in exact_sums(df, ["g"], {"x": F.col("x")}).collect()}


def test_sums_are_those_of_unlimited_precision(spark):
    """Tiny, huge, cancelling and mixed groups, bit for bit and under any partitioning."""
    rng = random.Random(1)
    groups = {
        "tiny": [1e-11] * 1000,
        "subnormal": [5e-324, 2e-310, -1e-320, 3e-308],
        "huge": [1e300, 1e15, -1e300, 1.0, 8e14, 8e14],
        "cancel": [1e300, 1e-11, -1e300],
        "negative": [-1e300, -1e-11, 1e300],
        "tie": [2.0**53, 1.0, 2.0**-70],
        "fares": [round(rng.uniform(0, 1e5), 2) for _ in range(3000)],
        "signs": [rng.uniform(-1, 1) * 10.0 ** rng.randint(-30, 30) for _ in range(500)],
        "any": [math.ldexp(rng.uniform(-1, 1), rng.randint(-900, 900)) for _ in range(500)],
        "zero": [0.0, -0.0, 1.5, -1.5],
    }
    rows = [(g, x) for g, values in groups.items() for x in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double")
    want = {g: math.fsum(values) for g, values in groups.items()}
    for n in (1, 7):
        assert sums(df.repartition(n)) == want


def test_partial_sums_are_bounded(spark):
    """Wide magnitudes in several columns add up to rows per column and digit, not to their product."""
    rng = random.Random(2)
    values = [[math.ldexp(rng.uniform(-1, 1), rng.randint(-1000, 1000)) for _ in range(3)] for _ in range(20_000)]
    df = spark.createDataFrame([(1, *v) for v in values], "k int, a double, b double, c double").repartition(5)
    columns = {n: F.col(n) for n in "abc"}
    parts = materialize(partial_sums(df, ["k"], columns), "parts")
    assert 100 < parts.count() <= 1 + 3 * LIMBS
    merged = merge_sums(parts, ["k"], list("abc"))
    assert tuple(merged.first()) == (1, 20_000, *(x for n in range(3) for x in (math.fsum(v[n] for v in values), 20_000)))
    assert "collect_list" not in merged._jdf.queryExecution().optimizedPlan().toString()


def test_sums_at_the_ends_of_the_core(spark):
    """Values at and beside the limits of the digits that are plain columns, and large totals."""
    rng = random.Random(4)
    ends = [2.0**-19, 2.0**48, 2.0**-20, math.nextafter(2.0**48, 0), math.nextafter(2.0**-19, 0), 1e-300, 1e306]
    groups = {f"g{i}": [rng.choice(ends) * rng.choice([1, -1]) for _ in range(rng.randint(1, 9))] for i in range(300)}
    groups["large"] = [2.0**48 - 1] * 5000
    groups["tie"] = [2.0**53, 1.0]
    groups["over"] = [2.0**53, 1.0, 2.0**-70]
    groups["under"] = [-(2.0**53), -1.0, 2.0**-19]
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g string, x double")
    assert sums(df.repartition(3)) == {g: math.fsum(v) for g, v in groups.items()}


def test_sum_edge_cases(spark):
    def total(values):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        sums = exact_sums(df, [], {"x": F.col("x")})
        return sums.select("x", mean_of("x"), "x_count", "row_count").first()

    assert tuple(total([])) == (None, None, 0, 0)
    assert tuple(total([None])) == (None, None, 0, 1)
    assert tuple(total([1.5, None, -0.5])) == (1.0, 0.5, 2, 3)
    assert total([0.1] * 10)[0] == 1.0
    assert total([float("inf"), 1.0])[0] == float("inf")
    for values in ([float("nan"), 1.0], [float("inf"), float("-inf")]):
        nan = total(values)[0]
        assert nan != nan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, how):
    # One key holds a third of the rows; ids may be NULL or unknown.
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 1)
        .when(F.col("id") % 50 == 1, F.lit(None))
        .otherwise(F.col("id") % 40)
        .alias("k"),
    )
    lookup = spark.range(30).select(F.col("id").alias("z"), F.concat(F.lit("n"), "id").alias("name"))
    if how in ("left_semi", "left_anti"):
        lookup = lookup.select("z")
    small = joins.lookup_join(rows, lookup, [("k", "z")], how, small=True)
    shuffled = joins.lookup_join(rows, lookup, [("k", "z")], how, small=False)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        salted = joins.lookup_join(rows, lookup, [("k", "z")], how, small=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    assert "_salt" in plan_of(salted) and "_salt" not in plan_of(shuffled)
    assert small.columns == shuffled.columns == salted.columns
    assert as_set(small) == as_set(shuffled) == as_set(salted)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_key_is_split(spark, how):
    """A key with a third of all rows is read by several tasks of the join."""
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "10KB")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 200_000, 1, 16).select(
            "id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k")
        )
        lookup = spark.range(199_000).select(F.col("id").alias("z"), F.lit("n").alias("name"))
        joined = joins.lookup_join(rows, lookup, [("k", "z")], how, small=False)
        count = joined.groupBy(F.col("id") % 2).count()
        total = sum(row["count"] for row in count.collect())
        unmatched = sum(i % 3 != 0 for i in range(199_000, 200_000))
        assert total == {"left": 200_000, "left_anti": unmatched}.get(how, 200_000 - unmatched)
        assert "skew=true" in plan_of(count)
    finally:
        for name in (
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.autoBroadcastJoinThreshold",
        ):
            spark.conf.unset(name)


def test_broadcast_is_checked(spark):
    lookup = spark.range(1000).withColumn("text", F.repeat(F.lit("x"), 1000))
    assert joins.fits_broadcast(lookup)
    assert not joins.fits_broadcast(lookup, max_rows=999)
    assert not joins.fits_broadcast(lookup, max_bytes=100_000)
    assert joins.fits_broadcast(lookup.limit(0))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_raw_scan_is_pruned_and_filtered(spark, raw_dir):
    plan = plan_of(stage(read_months(spark, raw_dir, 2025, 6)))
    read = re.search(r"ReadSchema: struct<([^>]*)", plan).group(1)
    assert "VendorID" not in read and "congestion" not in read
    pushed = plan[plan.index("PushedFilters") :]
    for condition in (
        "IsNotNull(tpep_pickup_datetime)",
        "GreaterThanOrEqual(trip_distance,0.0)",
        "LessThanOrEqual(total_amount,10000.0)",
    ):
        assert condition in pushed or "..." in pushed
    assert "Exchange" not in plan
    assert len(RAW_TRIP_SCHEMA) == 20


# What these queries write or collect on the way is checked by the plans of their parts.
LAZY = [
    "stg_trips",
    "fct_trips",
    "reject_reasons",
    "unmatched_zones",
    "daily_metrics",
    "zone_metrics",
    "monthly_metrics",
    "zone_monthly_growth",
    "zone_monthly_growth_shifted",
    "audit_rows",
    "refs_not_exists",
    "refs_not_in",
    "relationships",
    "group_completeness",
    "uniform_within_group",
    "missing_days",
    "multiset_diff",
    "table_checksum",
    "case_matrix",
    "validate_records",
]


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_cross_join_python_or_global_window(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in plan
    if "Window" in plan:
        assert not re.search(r"Window \[.*\], \[\w+", plan) or "Exchange SinglePartition" not in plan


def test_cases_are_neither_shuffled_nor_sorted_for_their_zones(spark):
    zones = zone_rows(spark)
    assert zones.dtypes == [("LocationID", "bigint"), ("Borough", "string"), ("Zone", "string"), ("service_zone", "string")]
    assert list(map(tuple, zones.collect())) == ZONES
    plan = plan_of(QUERIES["case_matrix"](spark, SF))
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_write_is_spread_with_and_without_adaptive_execution(spark, tmp_path):
    rows = spark.range(3000).select("id", (F.col("id") % 3 % 2).alias("k"))
    write_table(rows, f"{tmp_path}/adaptive", "k")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "monotonically_increasing_id" in plan_of(spread(rows, "k"))
        write_table(rows, f"{tmp_path}/salted", "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    a, b = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("adaptive", "salted"))
    assert a.exceptAll(b).isEmpty() and a.count() == b.count() == 3000


def test_ids_of_a_lookup_are_distinct_and_present(spark):
    lookup = spark.range(1000).select((F.col("id") % 300).alias("z"))
    lookup = lookup.unionAll(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    ids = joins.known_ids(lookup, "z")
    assert ids.count() == 300 and ids.where("z is null").isEmpty()


def test_salts_do_not_depend_on_what_rows_hold(spark):
    same = spark.range(0, 100_000, 1, 4).select(F.lit(7).alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    salted = with_salt(same, "s").groupBy("s").count().collect()
    assert len(salted) == salts(spark) and max(r["count"] for r in salted) < 2_000


def test_transformations_start_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "plans only")
    try:
        for name in set(LAZY) - {"relationships", "table_checksum"}:  # these look at file footers
            QUERIES[name](spark, SF)
        assert len(tracker.getJobIdsForGroup("lazy")) == 0
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_refreshes_read_only_their_months(spark):
    fct = _monthly_fct(spark, SF)
    target = metrics.daily_metrics(fct.where("pickup_date < DATE '1998-01-15'"))
    plan = plan_of(refresh.since_last_date(fct, materialize(target, "target")))
    assert re.search(r"PartitionFilters: \[[^\]]*pickup_month", plan)
