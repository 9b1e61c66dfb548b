"""The registered queries: every operator, run over the given tables."""

import datetime as dt
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripledger.contract import TABLES
from tripledger.functions.numeric import exact_sums
from tripledger.operators import compare, facts, groups, metrics, quality, records, refresh, staging
from tripledger.plans.build import append, build_summary, build_tables, restate
from tripledger.plans.publish import (
    POINTER,
    audit_publish,
    environment_checksums,
    point_views,
)
from tripledger.sources import files, fixture, months, sinks, versions, zones
from tripledger.sources.orders import ORDER_BOUNDS, order_trips, order_zones, table
from tripledger.sources.workdir import fresh_dir, materialize
from tripledger.streaming import ingest

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

EVENT_TYPES = ["view", "signup", "error", "click", "purchase"]
LATE = dt.datetime(1999, 1, 1)
LACKING = "MIDDLE EAST"  # the region whose zones the checks of references leave out


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs -------------------------------------------------------------------------


def _stg(spark: SparkSession, sf: str) -> DataFrame:
    return staging.stage(order_trips(spark, sf), ORDER_BOUNDS)


def _dim(spark: SparkSession, sf: str, without: str | None = None) -> DataFrame:
    return facts.dim_zones(order_zones(spark, sf, without))


def _fct(
    spark: SparkSession, sf: str, variant: str = "fare", without: str | None = None
) -> DataFrame:
    return facts.fct_trips(_stg(spark, sf), _dim(spark, sf, without), variant)


def _stored_fct(spark: SparkSession, sf: str) -> DataFrame:
    """Facts for queries that read them several times."""
    return materialize(_fct(spark, sf), "fct")


def _monthly_fct(spark: SparkSession, sf: str) -> DataFrame:
    """Facts stored by month, with the storage column by which refreshes skip months."""
    fct, path = _fct(spark, sf), fresh_dir(spark, "fct")
    facts.write_facts(fct, path)
    schema = T.StructType([*fct.schema, T.StructField(facts.PARTITION, T.DateType())])
    return spark.read.schema(schema).parquet(path)


def _early(fct: DataFrame) -> DataFrame:
    """Facts known before the late load arrives."""
    return fct.where(F.col("dropoff_datetime") < F.lit(LATE))


def _late(fct: DataFrame) -> DataFrame:
    return fct.where(F.col("dropoff_datetime") >= F.lit(LATE))


def _faulty(fct: DataFrame) -> DataFrame:
    """Facts with injected faults of every kind the checks look for."""
    distance, passengers = F.col("trip_distance"), F.col("passenger_count")
    nothing = F.lit(None)
    return fct.withColumns(
        {
            "dropoff_datetime": F.when(passengers == 7, nothing).otherwise(
                F.col("dropoff_datetime")
            ),
            "pickup_zone_id": F.when(passengers == 3, nothing).otherwise(F.col("pickup_zone_id")),
            "dropoff_zone_id": F.when(F.col("tolls_amount") == 0, F.lit(999)).otherwise(
                F.col("dropoff_zone_id")
            ),
            "trip_distance": F.when(distance == 50, -1.0).otherwise(distance),
            "total_amount": F.when(distance == 49, float("nan")).otherwise(F.col("total_amount")),
            "trip_duration_minutes": F.when(distance == 1, nothing).otherwise(
                F.col("trip_duration_minutes")
            ),
        }
    )


def _build(spark: SparkSession, sf: str, **options):
    return build_tables(order_trips(spark, sf), order_zones(spark, sf), ORDER_BOUNDS, **options)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the layout of measurement records."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    value = F.col("value")
    return table(spark, sf, "events").select(
        F.lit("events").alias("run_id"),
        F.col("event_type").alias("implementation"),
        F.concat(F.lit("u"), F.col("user_id")).alias("scenario"),
        F.lit("events").alias("dataset_kind"),
        F.month("ts").cast("bigint").alias("dataset_months"),
        F.year("ts").cast("bigint").alias("dataset_year"),
        F.lit(None).cast("bigint").alias("start_month"),
        k.alias("input_rows"),
        F.create_map(F.lit("rows"), k).alias("output_rows"),
        (value - 1.0).alias("execution_seconds"),
        F.array("event_type").alias("models_executed"),
        F.lit(None).cast("bigint").alias("rows_processed"),
        F.lit("stream").alias("strategy"),
        F.when(k <= 95, k.cast("double")).alias("database_size_mb"),
        F.col("event_id").cast("string").alias("timestamp"),
        F.when(value > 50, 1).otherwise(0).cast("bigint").alias("exit_code"),
        F.when(value > 100, "failed").otherwise("verified").alias("status"),
        (k != 13).alias("equivalent"),
    )


# --- staging, facts, metrics ---------------------------------------------------------------


@query
def stg_trips(spark, sf):
    return _stg(spark, sf)


@query
def payment_mix(spark, sf):
    return metrics.payment_mix(_stg(spark, sf))


@query
def reject_reasons(spark, sf):
    return staging.reject_counts(order_trips(spark, sf), ORDER_BOUNDS)


@query
def dim_zones(spark, sf):
    return _dim(spark, sf)


@query
def fct_trips(spark, sf):
    return _fct(spark, sf)


@query
def fct_trips_revenue_b(spark, sf):
    return _fct(spark, sf, "fare_tip_tolls")


@query
def unmatched_zones(spark, sf):
    return facts.unmatched_zones(_stg(spark, sf), _dim(spark, sf, LACKING))


@query
def daily_metrics(spark, sf):
    return metrics.daily_metrics(_fct(spark, sf))


@query
def daily_metrics_range(spark, sf):
    return metrics.daily_metrics(
        _fct(spark, sf), start=dt.date(1997, 1, 1), end=dt.date(1997, 12, 31)
    )


@query
def zone_metrics(spark, sf):
    return metrics.zone_metrics(_fct(spark, sf))


@query
def monthly_metrics(spark, sf):
    return metrics.monthly_metrics(metrics.daily_metrics(_fct(spark, sf)))


@query
def monthly_growth_lag(spark, sf):
    daily = metrics.daily_metrics(_fct(spark, sf))
    return metrics.month_over_month_lag(metrics.monthly_rollup(daily))


@query
def monthly_growth_selfjoin(spark, sf):
    daily = metrics.daily_metrics(_fct(spark, sf))
    return metrics.month_over_month_join(materialize(metrics.monthly_rollup(daily), "monthly"))


@query
def zone_monthly_growth(spark, sf):
    return metrics.month_over_month_lag(
        metrics.zone_monthly(_fct(spark, sf)), ["pickup_zone_id"]
    )


@query
def zone_monthly_growth_shifted(spark, sf):
    return metrics.month_over_month(metrics.zone_monthly(_fct(spark, sf)), ["pickup_zone_id"])


@query
def date_bounds(spark, sf):
    return metrics.date_bounds(order_trips(spark, sf), 1996, 6)


@query
def top_days(spark, sf):
    return metrics.top_days(metrics.daily_metrics(_fct(spark, sf)), 10)


@query
def ordered_zone_metrics(spark, sf):
    return metrics.canonical_order(metrics.zone_metrics(_fct(spark, sf)))


@query
def category_order(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("event_count"))
    ranked = metrics.with_category_rank(counts, "event_type", EVENT_TYPES, "position")
    return ranked.orderBy("position")


# --- quality -------------------------------------------------------------------------------


@query
def quality_report(spark, sf):
    fct = _stored_fct(spark, sf)
    dim = _dim(spark, sf)
    # Tables of calendar and zone size are stored, so that the report reads the facts once.
    daily = materialize(metrics.daily_metrics(fct.where("tip_amount > 0")), "daily")
    by_zone = materialize(metrics.zone_metrics(fct), "zones")
    return quality.quality_report(
        dim.unionAll(dim.where("borough = 'ASIA'")),
        _faulty(fct),
        daily,
        by_zone,
        metrics.monthly_metrics(daily),
        ORDER_BOUNDS,
    )


@query
def audit_rows(spark, sf):
    return quality.audit_rows(_faulty(_fct(spark, sf)), _dim(spark, sf, LACKING), ORDER_BOUNDS)


@query
def refs_not_exists(spark, sf):
    return quality.bad_references(_faulty(_fct(spark, sf)), _dim(spark, sf, LACKING))


@query
def refs_not_in(spark, sf):
    return quality.not_in_references(_faulty(_fct(spark, sf)), _dim(spark, sf, LACKING))


@query
def not_null(spark, sf):
    columns = ["pickup_datetime", "dropoff_datetime", "pickup_zone_id", "trip_duration_minutes"]
    return quality.not_null(_faulty(_fct(spark, sf)), columns)


@query
def accepted_range(spark, sf):
    fct = _faulty(_fct(spark, sf))
    checks = {
        "distance": quality.out_of_range(F.col("trip_distance"), 0.0, 40.0),
        "total": quality.out_of_range(F.col("total_amount"), 1000.0),
        "tip": quality.out_of_range(F.col("tip_percentage"), 0.0, 8.0),
    }
    return quality.count_failures(fct, checks)


@query
def order_check(spark, sf):
    # Raw trips, before the filter: shipped before they were ordered, or no date at all.
    typed = staging.typed_trips(order_trips(spark, sf))
    shipped = F.when(F.col("passenger_count") != 7, F.col("dropoff_datetime"))
    wrong = quality.out_of_order(F.col("pickup_datetime"), shipped)
    return quality.count_failures(typed, {"dropoff_after_pickup": wrong})


@query
def unique_keys(spark, sf):
    return quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def surplus_keys(spark, sf):
    return quality.surplus_keys(_faulty(_fct(spark, sf)), "pickup_zone_id")


@query
def relationships(spark, sf):
    child = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return quality.orphans(child, "doc_id", table(spark, sf, "labels"), "doc_id")


@query
def conservation(spark, sf):
    fct = _stored_fct(spark, sf)
    stale = metrics.daily_metrics(_early(fct))
    return quality.conservation(
        fct, {"daily_trip_count": stale, "zone_trip_count": metrics.zone_metrics(fct)}
    )


@query
def nonfinite_output(spark, sf):
    return quality.nonfinite(_faulty(_fct(spark, sf)))


@query
def group_completeness(spark, sf):
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return groups.group_completeness(events, ["user_id", "day"], "event_type", EVENT_TYPES)


@query
def uniform_within_group(spark, sf):
    orders = table(spark, sf, "orders")
    return groups.uniform_within_group(orders, ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query
def pivot(spark, sf):
    return groups.pivot_members(
        table(spark, sf, "events"), "user_id", "event_type", EVENT_TYPES[:4], "value"
    )


@query
def max_per_group(spark, sf):
    return groups.max_per_group(table(spark, sf, "events"), "event_type", "value")


# --- refresh -------------------------------------------------------------------------------


@query
def delete_insert(spark, sf):
    fct = _monthly_fct(spark, sf)
    target = materialize(metrics.daily_metrics(_early(fct)), "target")
    new = metrics.daily_metrics(refresh.since_last_date(fct, target))
    return refresh.delete_insert(target, new, "date")


def _restated(fct: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return metrics.daily_metrics(fct.where("payment_type <> 'cash'"), start=start, end=end)


RANGE = (dt.date(1997, 7, 1), dt.date(1998, 12, 31))


@query
def overwrite_range(spark, sf):
    fct = _stored_fct(spark, sf)
    target = metrics.daily_metrics(_early(fct))
    return refresh.overwrite_range(target, _restated(fct, *RANGE), "date", *RANGE)


@query
def table_overwrite_range(spark, sf):
    fct = _stored_fct(spark, sf)
    name, path = f"zone_months_{uuid4().hex}", fresh_dir(spark, "zone-months")
    target = metrics.zone_monthly(_early(fct))
    target.hint("rebalance", "month").write.partitionBy("month").option("path", path).saveAsTable(
        name
    )
    # The restated facts lack the months from April to June 1998, which must vanish.
    gone = F.trunc("pickup_date", "QUARTER") == F.lit(dt.date(1998, 4, 1))
    refresh.overwrite_table_range(spark, name, metrics.zone_monthly(fct.where(~gone)), "month", *RANGE)
    return spark.table(name)


@query
def overwrite_partitions(spark, sf):
    fct = _stored_fct(spark, sf)
    path = fresh_dir(spark, "zone-months")
    sinks.write_table(metrics.zone_monthly(_early(fct)), path, "month")
    refresh.overwrite_partitions(metrics.zone_monthly(_late(fct)), path, "month")
    return spark.read.parquet(path)


@query
def touched_dates(spark, sf):
    fct = _monthly_fct(spark, sf)
    target = metrics.daily_metrics(_early(fct))
    return refresh.refresh_touched(target, fct, _late(fct), metrics.daily_metrics)


@query
def restated_daily(spark, sf):
    raw = materialize(order_trips(spark, sf), "raw")
    dim = _dim(spark, sf)
    in_file = F.trunc("tpep_dropoff_datetime", "MM") == F.lit(dt.date(1998, 3, 1))
    corrected = raw.where(~in_file).unionAll(staging.correct_fares(raw.where(in_file)))
    start, end = dt.date(1997, 3, 1), dt.date(1998, 3, 31)

    def fct(rows: DataFrame) -> DataFrame:
        return facts.fct_trips(staging.stage(rows, ORDER_BOUNDS), dim)

    return refresh.overwrite_range(
        metrics.daily_metrics(fct(raw)),
        metrics.daily_metrics(fct(corrected), start=start, end=end),
        "date",
        start,
        end,
    )


@query
def restated_monthly(spark, sf):
    raw, raw_zones = order_trips(spark, sf), order_zones(spark, sf)
    before = build_tables(raw, raw_zones, ORDER_BOUNDS)
    in_file = F.trunc("tpep_dropoff_datetime", "MM") == F.lit(dt.date(1998, 3, 1))
    corrected = raw.where(~in_file).unionAll(staging.correct_fares(raw.where(in_file)))
    after = restate(
        before, corrected, raw_zones, dt.date(1997, 3, 1), dt.date(1998, 3, 31), ORDER_BOUNDS
    )
    return after.table(spark, "monthly_metrics")


@query
def new_month(spark, sf):
    """The daily table of a build to which the trips of a last month were added later."""
    raw = order_trips(spark, sf)
    arrived = F.coalesce(F.col("tpep_dropoff_datetime") >= F.lit(dt.datetime(1998, 10, 1)), F.lit(False))
    before = build_tables(raw.where(~arrived), order_zones(spark, sf), ORDER_BOUNDS)
    return append(before, raw.where(arrived), ORDER_BOUNDS).table(spark, "daily_metrics")


@query
def logic_change_diff(spark, sf):
    before = _build(spark, sf)
    raw, raw_zones = order_trips(spark, sf), order_zones(spark, sf)
    after = build_tables(raw, raw_zones, ORDER_BOUNDS, "fare_tip_tolls", reuse=before)
    report = compare.compare_all(
        spark, before.tables(spark), {"revenue_b": after.tables(spark)}
    )
    return report.select(
        "table_name", "baseline_rows", "candidate_rows", "differing_rows", "equivalent"
    )


@query
def missing_days(spark, sf):
    return refresh.missing_days(
        table(spark, sf, "events"), "ts", dt.date(2024, 1, 1), dt.date(2024, 1, 31), ["user_id"]
    )


@query
def day_ranges(spark, sf):
    return refresh.day_ranges(table(spark, sf, "events"), "ts", ["user_id"], max_days=7)


@query
def day_ranges_all(spark, sf):
    return refresh.day_ranges(_stg(spark, sf), "pickup_date", max_days=30)


# --- comparison ----------------------------------------------------------------------------


@query
def multiset_diff(spark, sf):
    lines = table(spark, sf, "lineitem")
    other = lines.where("l_returnflag <> 'R'").unionAll(lines.where("l_returnflag = 'A'"))
    return compare.multiset_diff(lines, other)


@query
def positional_mismatches(spark, sf):
    left = table(spark, sf, "orders")
    right = left.where("o_orderstatus <> 'P'").withColumn(
        "o_orderpriority", F.nullif("o_orderpriority", F.lit("1-URGENT"))
    )
    return compare.positional_mismatches(left, right)


@query
def tolerance_diff(spark, sf):
    fct = _stored_fct(spark, sf)
    right = metrics.daily_metrics(fct.where("tip_amount > 0"))
    right = right.unionAll(right.where("date >= DATE '1998-07-01'"))  # keys that stand twice
    found = compare.tolerance_diff(metrics.daily_metrics(fct), right, ["date"], 0.05)
    as_number = {c: F.col(c).cast("double") for c in ("left_value", "right_value")}
    return found.withColumns(as_number)


@query
def table_checksum(spark, sf):
    tables = {name: table(spark, sf, name) for name in GIVEN}
    # as whole numbers, since the two engines write floats differently
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(2.0**40)))
    tables["embeddings"] = tables["embeddings"].withColumn("embedding", whole)
    return compare.checksums(tables)


@query
def schema_report(spark, sf):
    """What the comparison says about tables whose columns differ in type, name, order or number, about
    one that is missing, and about one that is the same."""
    names = ["orders", "events", "customer", "part", "supplier", "nation", "region"]
    before = {name: table(spark, sf, name) for name in names}
    after = dict(before)
    after["events"] = before["events"].withColumn("value", F.col("value").cast("decimal(20,6)"))
    after["customer"] = before["customer"].withColumnRenamed("c_name", "C_name")
    after["part"] = before["part"].select(*reversed(before["part"].columns[:2]), *before["part"].columns[2:])
    after["supplier"] = before["supplier"].drop("s_acctbal")
    after["nation"] = before["nation"].withColumn("n_note", F.lit("x"))
    after["region"] = None
    report = compare.compare_all(spark, before, {"altered": after}, count_differences=False)
    return report.drop("candidate", "differing_rows")


# --- publishing ----------------------------------------------------------------------------


@query
def build_counts(spark, sf):
    return build_summary(spark, _build(spark, sf))


@query
def write_audit_publish(spark, sf):
    database = f"prod_{uuid4().hex}"
    audit_publish(spark, database, _build(spark, sf), ORDER_BOUNDS)
    published = None
    for name in TABLES:
        count = spark.table(f"{database}.{name}").select(F.lit(name).alias("table_name"))
        published = count if published is None else published.unionAll(count)
    return published.groupBy("table_name").agg(F.count("*").alias("row_count"))


def _prod_and_dev(spark: SparkSession, sf: str) -> tuple[str, str, DataFrame]:
    """Publish production, then a development copy with a shifted mean fare."""
    prod, dev = f"prod_{uuid4().hex}", f"dev_{uuid4().hex}"
    raw, raw_zones = order_trips(spark, sf), order_zones(spark, sf)
    first = build_tables(raw, raw_zones, ORDER_BOUNDS)
    point_views(spark, prod, first.paths)
    before = materialize(environment_checksums(spark, prod, list(TABLES)), "checksums")
    second = build_tables(raw, raw_zones, ORDER_BOUNDS, fare_offset=1.0, reuse=first)
    point_views(spark, dev, {**first.paths, "daily_metrics": second.paths["daily_metrics"]})
    return prod, dev, before


@query
def dev_environment(spark, sf):
    prod, dev, _ = _prod_and_dev(spark, sf)
    live = spark.table(f"{prod}.daily_metrics").select(
        "date", F.col("average_fare").alias("prod_average_fare")
    )
    trial = spark.table(f"{dev}.daily_metrics").select(
        "date", "trip_count", F.col("average_fare").alias("dev_average_fare")
    )
    return trial.join(live, "date")


@query
def prod_unchanged(spark, sf):
    """Production against its first state: with a development copy beside it, and once the copy
    has been promoted."""
    prod, dev, before = _prod_and_dev(spark, sf)
    beside = materialize(environment_checksums(spark, prod, list(TABLES)), "checksums")
    point_views(spark, prod, spark.table(f"{dev}.{POINTER}").first().paths)
    promoted = materialize(environment_checksums(spark, prod, list(TABLES)), "checksums")
    steps = [
        compare.unchanged(before, after).select(F.lit(step).alias("step"), "*")
        for step, after in (("development", beside), ("promotion", promoted))
    ]
    return steps[0].unionAll(steps[1])


@query
def table_schemas(spark, sf):
    """Columns of the given tables in order."""
    rows = [
        (name, i, column, kind)
        for name in GIVEN
        for i, (column, kind) in enumerate(sinks.table_schema(table(spark, sf, name)), 1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, position int, column_name string, column_type string"
    )


@query
def published_comments(spark, sf):
    """Comments of the columns that readers of the published views see."""
    database = f"prod_{uuid4().hex}"
    point_views(spark, database, _build(spark, sf).paths)
    rows = [
        (name, column.name, column.description)
        for name in TABLES
        for column in spark.catalog.listColumns(f"{database}.{name}")
        if column.description
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, comment string")


@query
def input_gate(spark, sf):
    """What the check of a zone lookup says to good and bad ones, before anything is written."""
    good = order_zones(spark, sf)
    lookups = {
        "good": good,
        "empty": good.limit(0),
        "repeated": good.unionAll(good.where("Borough = 'ASIA'")),
        "no_id": good.withColumn("LocationID", F.nullif("LocationID", F.lit(3))),
    }
    rows = []
    for name, lookup in lookups.items():
        try:
            zones.check_zone_lookup(lookup)
            rows.append((name, True))
        except ValueError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "lookup string, accepted boolean")


# --- files ---------------------------------------------------------------------------------


@query
def union_by_name(spark, sf):
    lines = table(spark, sf, "lineitem")
    path = fresh_dir(spark, "drift")
    is_old = F.col("l_shipdate") < F.lit(dt.datetime(1998, 1, 1))
    old = lines.where(is_old).select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").cast("bigint").alias("l_quantity"),
        F.col("l_discount").alias("L_Discount"),
    )
    new = lines.where(~is_old).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"
    )
    sinks.write_table(old, f"{path}/old")
    sinks.write_table(new, f"{path}/new")
    both = months.read_union_by_name(spark, [f"{path}/new", f"{path}/old"])
    return both.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")


@query
def month_drift(spark, sf):
    path = fresh_dir(spark, "months")
    uploaded = F.date_format("tpep_dropoff_datetime", "yyyy-MM")
    sinks.write_table(
        order_trips(spark, sf).withColumn("upload_month", uploaded), path, "upload_month"
    )
    return months.month_drift(
        spark, path, 1998, 12, pattern="upload_month={year}-{month:02d}"
    )


@query
def zone_csv(spark, sf):
    path = fresh_dir(spark, "zones")
    sinks.write_csv(order_zones(spark, sf), path)
    lookup = zones.read_zone_csv(spark, path)
    zones.check_zone_lookup(lookup)
    return facts.dim_zones(lookup)


@query
def csv_records(spark, sf):
    """Every text as it is, and once more with spaces, line ends, quotes and commas around it, empty,
    and NULL."""
    path = fresh_dir(spark, "records")
    around = F.concat(F.lit("  "), "text", F.lit(' , "quoted" \r\n \\ '))
    cells = F.array("text", around, F.lit(""), F.lit(None).cast("string"))
    documents = table(spark, sf, "documents")
    others = [c for c in documents.columns if c != "text"]
    documents = documents.select(*others, F.posexplode(cells).alias("version", "text"))
    nested = documents.withColumn("tags", F.create_map(F.lit("source"), "source"))
    sinks.write_csv(nested, path)
    return sinks.read_csv(spark, path, sinks.nested_as_json(nested).schema)


@query
def json_records(spark, sf):
    path = fresh_dir(spark, "records")
    sinks.write_json(_records(spark, sf), path)
    back = sinks.read_json(spark, path, records.RECORD_SCHEMA)
    return back.select(
        "timestamp", "implementation", "execution_seconds", "database_size_mb", "equivalent",
        F.col("output_rows")["rows"].alias("output_row_count"),
        F.col("models_executed")[0].alias("first_model"),
    )


@query
def file_manifest(spark, sf):
    return files.file_manifest(spark, [f"{sf.rstrip('/')}/*.parquet"])


def _order_files(spark: SparkSession, sf: str) -> str:
    """Orders as text files of a thousand order keys each, in the order of the keys."""
    path = fresh_dir(spark, "lines")
    line = F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr("o_orderkey div 1000").alias("part"), line.alias("line"))
    rows = rows.repartition("part").sortWithinPartitions("part", "o_orderkey")
    rows.select("part", "line").write.option("lineSep", "\n").partitionBy("part").text(path)
    return path


@query
def text_manifest(spark, sf):
    """Size and SHA-256 of files whose bytes are known."""
    found = files.file_manifest(spark, [f"{_order_files(spark, sf)}/*"])
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint")
    return found.select(part.alias("part"), "bytes", "sha256")


@query
def text_storage(spark, sf):
    """Number and size of files whose bytes are known."""
    return files.storage_stats(spark, {"orders": _order_files(spark, sf)}, "part-*")


@query
def changed_files(spark, sf):
    raw = order_trips(spark, sf).withColumn("upload_year", F.year("tpep_dropoff_datetime"))
    before, after = fresh_dir(spark, "before"), fresh_dir(spark, "after")
    sinks.write_table(raw, before, "upload_year")
    stored = spark.read.parquet(before)
    in_file = F.col("upload_year") == 1998
    corrected = stored.where(~in_file).unionAll(staging.correct_fares(stored.where(in_file)))
    sinks.write_table(corrected, after, "upload_year")
    folder = F.regexp_extract("_metadata.file_path", r"upload_year=[^/]+", 0)
    return files.changed_files(
        files.table_manifest(stored, folder), files.table_manifest(spark.read.parquet(after), folder)
    )


@query
def storage_stats(spark, sf):
    build = _build(spark, sf)
    return files.storage_stats(spark, {name: versions.parts(where)[0][0] for name, where in build.paths.items()})


@query
def case_matrix(spark, sf):
    cases = fixture.case_matrix(
        table(spark, sf, "orders").select(F.trunc("o_orderdate", "MM").alias("month"))
    )
    lookup = facts.dim_zones(fixture.zone_rows(spark))
    typed = staging.classify_rejects(staging.typed_trips(cases, keep=["case_name"]))
    flagged = facts.with_zone_flags(typed, lookup)
    unmatched = F.when(F.expr("pickup_unknown OR dropoff_unknown"), "unmatched").otherwise("fact")
    fates = flagged.withColumn("fate", F.coalesce("reject_reason", unmatched))
    values = {"fare_sum": F.col("fare_amount"), "minutes": F.col("trip_duration_minutes")}
    sums = exact_sums(fates, ["case_name", "fate"], values)
    return sums.select("case_name", "fate", F.col("row_count").alias("trip_count"), *values)


# --- measurement records -------------------------------------------------------------------


@query
def validate_records(spark, sf):
    checked = records.classify_records(_records(spark, sf), EVENT_TYPES[:4])
    return checked.groupBy("implementation", "reject_reason").agg(
        F.count("*").alias("record_count")
    )


@query
def record_set_problems(spark, sf):
    return records.set_problems(_records(spark, sf), EVENT_TYPES)


HOURS = [f"h{hour:02d}" for hour in range(24)]


def _hourly_records(spark: SparkSession, sf: str) -> DataFrame:
    """A valid set of records: for each hour of the day, one for each type of event."""
    n = F.col("n")
    largest = [F.coalesce(F.max(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0)) for kind in EVENT_TYPES]
    pairs = [F.struct(F.lit(kind).alias("kind"), x.alias("largest")) for kind, x in zip(EVENT_TYPES, largest)]
    hour = F.concat(F.lit("h"), F.lpad(F.hour("ts").cast("string"), 2, "0"))
    hours = table(spark, sf, "events").groupBy(hour.alias("scenario")).agg(F.count("*").alias("n"), F.array(*pairs).alias("pairs"))
    fixed = {
        "run_id": "events", "dataset_kind": "events", "dataset_months": 1, "dataset_year": 2024, "start_month": 1,
        "strategy": "stream", "timestamp": "2024-01-31", "exit_code": 0, "status": "verified", "equivalent": True,
    }
    own = {
        "scenario": F.col("scenario"), "implementation": F.col("kind"), "input_rows": n, "rows_processed": n,
        "output_rows": F.create_map(F.lit("events"), n), "execution_seconds": F.col("largest"),
        "models_executed": F.array("kind"), "database_size_mb": n.cast("double"),
    }
    values = {name: F.lit(value) for name, value in fixed.items()} | own
    rows = hours.select("scenario", "n", F.inline("pairs"))
    return rows.select(*(values[f.name].cast(f.dataType).alias(f.name) for f in records.RECORD_SCHEMA))


@query
def records_read(spark, sf):
    """Records read from files: a valid set, in display order, and three sets that a single record
    spoils."""
    valid = materialize(_hourly_records(spark, sf), "records")
    one = (F.col("scenario") == "h05") & (F.col("implementation") == "click")
    sets = {
        "valid": valid,
        "failed": valid.withColumn("status", F.when(one, "failed").otherwise(F.col("status"))),
        "incomplete": valid.where(~one),
        "mixed": valid.withColumn("input_rows", F.col("input_rows") + one.cast("int")),
    }
    shown = ["scenario", "implementation", "execution_seconds", "input_rows"]
    out = None
    for name, rows in sets.items():
        path = fresh_dir(spark, "records")
        sinks.write_json(rows, path)
        try:
            found = records.load_measurements(spark, path, EVENT_TYPES, HOURS, array=False)
            found = found.select(F.lit(name).alias("record_set"), F.lit(True).alias("accepted"), *shown)
        except records.InvalidRecords:
            nothing = [F.lit(None).cast(valid.schema[c].dataType).alias(c) for c in shown]
            found = spark.range(1).select(F.lit(name).alias("record_set"), F.lit(False).alias("accepted"), *nothing)
        out = found if out is None else out.unionAll(found)
    return out


@query
def run_summary(spark, sf):
    return records.summary(_records(spark, sf))


@query
def executed_steps(spark, sf):
    status = F.when(F.col("value") > 5, "success").otherwise("error")

    def step(prefix: str, result) -> Column:
        return F.struct(
            F.concat(F.lit(prefix), F.col("event_type")).alias("unique_id"), result.alias("status")
        )

    runs = table(spark, sf, "events").select(
        "event_id",
        F.array(step("model.shop.", status), step("test.shop.not_null_", F.lit("success"))).alias(
            "results"
        ),
    )
    return records.executed_steps(runs, "results")


@query
def run_status(spark, sf):
    events = table(spark, sf, "events")
    runs = events.groupBy("user_id").agg(
        F.max(F.when(F.col("value") > 300, 1).otherwise(0)).alias("exit_code")
    )
    verdicts = events.where("event_type = 'click'").select(
        "user_id", (F.col("value") < 40).alias("passed")
    )
    return records.run_status(runs, verdicts, "user_id")


# --- streaming -----------------------------------------------------------------------------


def _inbox(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of trips that arrives in about three batches, late rows in each."""
    path = fresh_dir(spark, "inbox")
    raw = order_trips(spark, sf)
    drop = F.year("tpep_dropoff_datetime") - 1995
    sinks.write_table(raw.withColumn("drop", F.least(F.greatest(drop, F.lit(0)), F.lit(5))), path, "drop")
    arrived = files.storage_stats(spark, {"inbox": path}).first().files
    return ingest.read_drops(spark, path, raw.schema, files_per_batch=-(-arrived // 3))


@query
def stream_touched_dates(spark, sf):
    target = fresh_dir(spark, "stream")
    stream = ingest.stream_ingest(_inbox(spark, sf), _dim(spark, sf), target, ORDER_BOUNDS)
    stream.awaitTermination()
    return ingest.latest(spark, f"{target}/daily", "date")


@query
def stream_rejects(spark, sf):
    target = fresh_dir(spark, "stream")
    ingest.stream_rejects(_inbox(spark, sf), target, ORDER_BOUNDS).awaitTermination()
    return ingest.latest(spark, f"{target}/rejects", "reject_reason")


@query
def stream_daily(spark, sf):
    target = fresh_dir(spark, "stream")
    stream = ingest.stream_daily(_inbox(spark, sf), _dim(spark, sf), target, ORDER_BOUNDS)
    stream.awaitTermination()
    return ingest.latest(spark, f"{target}/daily_state", "date")
