"""Proving two tables equal: schema, multiset, position, checksum, tolerance."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripledger.functions.numeric import failures, is_finite
from tripledger.sources.workdir import materialize


#: Every difference between two values shows in their JSON.
JSON_EXACT = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def schema_diff(left: DataFrame, right: DataFrame) -> list[str]:
    """Differences in column order, name and type; empty when the schemas agree."""
    a, b = left.dtypes, right.dtypes
    problems = [] if len(a) == len(b) else [f"{len(a)} columns against {len(b)}"]
    problems += [f"column {i}: {x} against {y}" for i, (x, y) in enumerate(zip(a, b)) if x != y]
    return problems


def _require_same_schema(left: DataFrame, right: DataFrame) -> None:
    problems = schema_diff(left, right)
    if problems:
        raise ValueError("tables differ in schema: " + "; ".join(problems))


def _copies(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of two tables with their number of copies on each side. Grouping counts
    copies before the shuffle, so a row repeated very often costs one row per task."""
    _require_same_schema(left, right)
    both = left.select("*", F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(
        right.select("*", F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return both.groupBy(*left.columns).agg(
        F.sum("_l").alias("left_copies"), F.sum("_r").alias("right_copies")
    )


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with ``copies_delta`` = right minus left."""
    delta = F.col("right_copies") - F.col("left_copies")
    return (
        _copies(left, right).select(*left.columns, delta.alias("copies_delta")).where(
            F.col("copies_delta") != 0
        )
    )


def positional_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts of two tables and the number of positions at which they differ once both
    are sorted by all columns (NULLs last). Not an edit distance.

    The copies of one row value fill a run of positions on either side, so a value contributes
    the overlap of its two runs and rows are never aligned one by one. Runs come from a
    distributed running total: distinct rows are range-partitioned once, and each range adds
    the totals of the ranges before it.
    """
    order = [F.col(name).asc_nulls_last() for name in left.columns]
    # The ranges are sampled, so they are written down before being used twice.
    ranged = materialize(
        _copies(left, right).repartitionByRange(*order).withColumn(
            "_range", F.spark_partition_id()
        ),
        "ranges",
    )
    sides = ("left_copies", "right_copies")
    # One row per range, that is per shuffle partition.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(*(F.sum(side).alias(side) for side in sides))
        .select(
            F.col("_range").alias("_offset_range"),
            *(
                F.coalesce(F.sum(side).over(earlier), F.lit(0)).alias(f"{side}_before")
                for side in sides
            ),
        )
    )
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ends = ranged.select(
        "_range", *sides, *(F.sum(side).over(within).alias(f"{side}_run") for side in sides)
    )
    placed = ends.join(F.broadcast(offsets), F.col("_range") == F.col("_offset_range"))
    end = {side: F.col(f"{side}_before") + F.col(f"{side}_run") for side in sides}
    start = {side: end[side] - F.col(side) for side in sides}
    overlap = F.least(*end.values()) - F.greatest(*start.values())
    totals = placed.agg(
        F.coalesce(F.sum("left_copies"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("right_copies"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.greatest(overlap, F.lit(0))), F.lit(0)).alias("_equal"),
    )
    longer = F.greatest("left_rows", "right_rows")
    return totals.select("left_rows", "right_rows", (longer - F.col("_equal")).alias("mismatches"))


def row_fingerprint(columns: Sequence[str]) -> Column:
    """SHA-256 of a row as JSON; NULL fields are written out, so they differ from absent ones, and
    timestamps to the microsecond."""
    row = F.to_json(F.struct(*(F.col(name) for name in columns)), JSON_EXACT)
    return F.sha2(row, 256)


def checksum_columns(fingerprint: str) -> list[Column]:
    """Aggregates: row count, and a checksum that ignores order but not repetition.

    Two 60-bit parts of every fingerprint are added up. XOR would let copies cancel out.
    """

    def part(start: int) -> Column:
        digits = F.conv(F.substring(fingerprint, start, 15), 16, 10)
        return F.coalesce(F.sum(digits.cast("decimal(28,0)")), F.lit(0)).cast("string")

    return [
        F.count(F.lit(1)).alias("row_count"),
        F.concat_ws("-", part(1), part(16)).alias("checksum"),
    ]


def table_checksum(df: DataFrame) -> DataFrame:
    """One row: (row_count, checksum)."""
    prints = df.select(row_fingerprint(df.columns).alias("fingerprint"))
    return prints.agg(*checksum_columns("fingerprint"))


def checksums(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count, checksum) for several tables."""
    return reduce(
        DataFrame.unionAll,
        (table_checksum(df).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()),
    )


#: A hash of 64 bits is added up in three digits of at most 22 bits, for two trillion rows.
DIGITS = ((42, 22), (21, 21), (0, 21))


def row_hashes(schema: T.StructType) -> list[Column]:
    """Two XXH64 of a row, together 128 bits, over its typed values: timestamps as microseconds,
    numbers as their bits, texts as their bytes. Nothing is written out but nested values.

    A hash passes over NULL and takes -0.0 for 0.0, so flags say which columns hold either; names
    and types go in too. For proving that one engine's tables are equal; against somebody who wants
    two tables to look equal, and between engines, ``row_fingerprint`` is the one to use.
    """
    flags, values = [], []
    for field in schema:
        value, nested = F.col(f"`{field.name}`"), isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType))
        flags.append(value.isNull())
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            # written out for zeros alone
            flags.append((value == 0) & value.cast("string").startswith("-"))
        values.append(exact_json(value, field.dataType) if nested else value)
    words = []
    for start in range(0, len(flags), 62):
        bits = (F.when(flag, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, flag in enumerate(flags[start : start + 62]))
        words.append(reduce(Column.__add__, bits))
    return [F.xxhash64(F.lit(which), F.lit(schema.simpleString()), *words, *values) for which in (0, 1)]


def content_columns(*hashes: str) -> list[Column]:
    """Aggregates over hash columns: row count, and a checksum that ignores order but not repetition."""
    sums = []
    for name in hashes:
        for shift, size in DIGITS:
            digit = F.shiftrightunsigned(name, shift).bitwiseAND(F.lit((1 << size) - 1))
            sums.append(F.lower(F.hex(F.coalesce(F.sum(digit), F.lit(0)))))
    return [F.count(F.lit(1)).alias("row_count"), F.concat_ws("-", *sums).alias("checksum")]


def hashed(df: DataFrame, *others: Column) -> DataFrame:
    """The two hashes of every row as ``h0`` and ``h1``, and other columns."""
    return df.select(*(h.alias(f"h{i}") for i, h in enumerate(row_hashes(df.schema))), *others)


def content_checksum(df: DataFrame) -> DataFrame:
    """One row: (row_count, checksum) from typed values, for tables of this engine."""
    return hashed(df).agg(*content_columns("h0", "h1"))


def content_checksums(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count, checksum) for several tables, from typed values."""
    return reduce(
        DataFrame.unionAll,
        (content_checksum(df).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()),
    )


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, unchanged) from two checksum tables."""
    old = before.select("table_name", F.struct("row_count", "checksum").alias("old"))
    new = after.select("table_name", F.struct("row_count", "checksum").alias("new"))
    same = F.coalesce(F.col("old") == F.col("new"), F.lit(False))
    return old.join(new, "table_name", "full_outer").select("table_name", same.alias("unchanged"))


def tolerance_diff(
    left: DataFrame, right: DataFrame, keys: Sequence[str], epsilon: float
) -> DataFrame:
    """Cells that differ, as (keys, column_name, left_value, right_value) with the values as text.

    Numbers differ if they are further apart than ``epsilon`` times the larger magnitude; all
    other values if they are not the same. NULL equals NULL only,
    NaN equals NaN only. Keys may be NULL. A key that one side lacks is reported as ``only_left``
    or ``only_right``, and one that a side has several times as ``repeated_left`` or
    ``repeated_right`` with the numbers of rows; the cells of a repeated key are not compared, as
    there is no telling which row belongs to which.
    """
    _require_same_schema(left, right)
    measures = [f for f in left.schema if f.name not in keys]
    one = F.lit(1).alias("_one")
    values = F.struct(one, *(F.col(f.name).alias(f"c{i}") for i, f in enumerate(measures)))
    shown = F.struct(one, *(comparable(left, f.name).alias(f"c{i}") for i, f in enumerate(measures)))

    def side(df: DataFrame, mine: str) -> DataFrame:
        return df.select(*keys, values.alias("value"), shown.alias("text"), F.lit(mine).alias("_side"))

    both = side(left, "l").unionAll(side(right, "r"))
    first = []
    for s in "lr":
        here = F.col("_side") == s
        first += [
            failures(here).alias(f"{s}n"),
            F.first(F.when(here, F.col("value")), ignorenulls=True).alias(s),
            F.first(F.when(here, F.col("text")), ignorenulls=True).alias(f"{s}t"),
        ]
    # Grouping on the keys aligns the two sides; it treats NULL keys as equal.
    paired = both.groupBy(*keys).agg(*first)

    def cell(name: str, show: Column, a: Column, b: Column) -> Column:
        entry = F.struct(
            F.lit(name).alias("column_name"),
            a.cast("string").alias("left_value"),
            b.cast("string").alias("right_value"),
        )
        return F.when(show, entry)

    def differs(field: T.StructField, i: int) -> Column:
        a, b = F.col(f"l.c{i}"), F.col(f"r.c{i}")
        if not isinstance(field.dataType, T.NumericType):
            return ~F.col(f"lt.c{i}").eqNullSafe(F.col(f"rt.c{i}"))
        x, y = a.cast("double"), b.cast("double")
        close = F.abs(x - y) <= F.lit(epsilon) * F.greatest(F.abs(x), F.abs(y))
        return ~(a.eqNullSafe(b) | F.coalesce(close & is_finite(x) & is_finite(y), F.lit(False)))

    single = (F.col("ln") == 1) & (F.col("rn") == 1)
    null, counts = F.lit(None), (F.col("ln"), F.col("rn"))
    cells = [
        cell("only_left", F.col("rn") == 0, null, null),
        cell("only_right", F.col("ln") == 0, null, null),
        cell("repeated_left", F.col("ln") > 1, *counts),
        cell("repeated_right", F.col("rn") > 1, *counts),
        *(
            cell(f.name, single & differs(f, i), F.col(f"lt.c{i}"), F.col(f"rt.c{i}"))
            for i, f in enumerate(measures)
        ),
    ]
    return paired.select(*keys, F.inline(F.array_compact(F.array(*cells))))


def comparable(df: DataFrame, field: str) -> Column:
    """A column as text that is equal exactly where the values are; maps ignore entry order."""
    kind = df.schema[field].dataType
    value = F.col(field)
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
        return exact_json(value, kind)
    return F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")


def exact_json(value: Column, kind: T.DataType) -> Column:
    """A nested value as JSON; the entries of a map in the order of their keys."""
    return F.to_json(F.array_sort(F.map_entries(value)) if isinstance(kind, T.MapType) else value, JSON_EXACT)


_REPORT = (
    "table_name string, candidate string, same_schema boolean, baseline_rows bigint, "
    "candidate_rows bigint, differing_rows bigint, nonfinite_rows bigint, equivalent boolean, "
    "error string"
)


def _any_nonfinite(df: DataFrame) -> Column:
    doubles = (F.col(f.name) for f in df.schema if f.dataType == T.DoubleType())
    return reduce(Column.__or__, (~is_finite(c) for c in doubles), F.lit(False))


def _counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts from matching all rows of the two tables."""
    return _copies(left, right).agg(
        F.sum("left_copies").alias("baseline_rows"),
        F.sum("right_copies").alias("candidate_rows"),
        F.coalesce(
            F.sum(F.abs(F.col("right_copies") - F.col("left_copies"))), F.lit(0)
        ).alias("differing_rows"),
        failures(_any_nonfinite(left)).alias("nonfinite_rows"),
    ).withColumn("_equal", F.col("differing_rows") == 0)


def _checksummed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts from one checksum pass per table; no row is shuffled."""
    sides = [
        hashed(df, _any_nonfinite(df).alias("bad"))
        .agg(*content_columns("h0", "h1"), failures(F.col("bad")).alias("bad"))
        .withColumn("side", F.lit(side))
        for side, df in (("l", left), ("r", right))
    ]
    return sides[0].unionAll(sides[1]).agg(
        F.max(F.when(F.col("side") == "l", F.col("row_count"))).alias("baseline_rows"),
        F.max(F.when(F.col("side") == "r", F.col("row_count"))).alias("candidate_rows"),
        F.lit(None).cast("bigint").alias("differing_rows"),
        F.sum("bad").alias("nonfinite_rows"),
        (F.min(F.struct("row_count", "checksum")) == F.max(F.struct("row_count", "checksum"))).alias(
            "_equal"
        ),
    )


def _row_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts alone, for tables whose rows cannot be compared."""
    sides = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return sides.agg(
        F.sum("l").alias("baseline_rows"),
        F.sum("r").alias("candidate_rows"),
        F.lit(None).cast("bigint").alias("differing_rows"),
        F.lit(None).cast("bigint").alias("nonfinite_rows"),
        F.lit(False).alias("_equal"),
    )


def compare_table(
    name: str, candidate: str, left: DataFrame, right: DataFrame, count_differences: bool = True
) -> DataFrame:
    """One report row for one table. ``differing_rows`` sums the absolute copy differences;
    NaN or infinity on either side rules equivalence out. Without ``count_differences`` the
    verdict comes from checksums, which spares large tables the shuffle of their rows."""
    problems = schema_diff(left, right)
    if problems:
        counts = _row_counts(left, right)
    else:
        counts = (_counted if count_differences else _checksummed)(left, right)
    zero = F.lit(0).cast("bigint")
    clean = F.coalesce(F.col("nonfinite_rows") == 0, F.lit(False))
    error = F.lit("; ".join(problems)) if problems else F.when(~clean, "non-finite values")
    return counts.select(
        F.lit(name).alias("table_name"),
        F.lit(candidate).alias("candidate"),
        F.lit(not problems).alias("same_schema"),
        F.coalesce("baseline_rows", zero).alias("baseline_rows"),
        F.coalesce("candidate_rows", zero).alias("candidate_rows"),
        "differing_rows",
        "nonfinite_rows",
        (F.col("_equal") & clean).alias("equivalent"),
        error.alias("error"),
    )


def compare_all(
    spark: SparkSession,
    baseline: dict[str, DataFrame | None],
    candidates: dict[str, dict[str, DataFrame | None]],
    count_differences: bool = True,
) -> DataFrame:
    """Compare every table of every candidate with the baseline, in one report. A table that
    either side lacks is a reported error."""
    reports = []
    for label, tables in candidates.items():
        for name in dict.fromkeys([*baseline, *tables]):
            left, right = baseline.get(name), tables.get(name)
            if left is None or right is None:
                gone = "baseline" if left is None else label
                row = (name, label, None, None, None, None, None, False, f"{name} missing in {gone}")
                reports.append(spark.createDataFrame([row], _REPORT))
            else:
                reports.append(compare_table(name, label, left, right, count_differences))
    if not reports:
        raise ValueError("nothing to compare")
    return reduce(DataFrame.unionAll, reports)


def database_tables(
    spark: SparkSession, database: str, names: Sequence[str]
) -> dict[str, DataFrame | None]:
    """Named tables or views of a database; None where one does not exist."""
    return {
        name: spark.table(f"{database}.{name}")
        if spark.catalog.tableExists(f"{database}.{name}")
        else None
        for name in names
    }
