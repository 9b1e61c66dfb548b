"""Every way in which two tables can differ must be noticed, and nothing else."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from tripledger.operators.compare import (
    comparable,
    compare_all,
    content_checksum,
    database_tables,
    hashed,
    multiset_diff,
    positional_mismatches,
    schema_diff,
    table_checksum,
    tolerance_diff,
)


def events(spark, rows=None):
    """Times to the microsecond, maps, special doubles, long texts; one row stands three times."""
    rows = rows or [
        (dt.datetime(2030, 1, 2, 3, 4, 5, 123456), {"a": 1, "b": 2}, -0.0, "x" * 3000, 5),
        (dt.datetime(2030, 1, 2, 3, 4, 5, 123456), {"a": 1, "b": 2}, 0.5, "tab\t'quote\"", 6),
        *[(None, {}, 1e-300, "", None)] * 3,
        (dt.datetime(1969, 12, 31, 23, 59, 59, 1), {"": 0}, 1e300, None, 2**62),
    ]
    return spark.createDataFrame(
        rows, "at timestamp, tags map<string,int>, level double, note string, number bigint"
    )


def flat(df):
    """Without the map, which cannot be grouped or sorted."""
    return df.withColumn("tags", comparable(df, "tags"))


CHANGES = {
    "one microsecond": {"at": "at + INTERVAL 0.000001 SECOND"},
    "a map value": {"tags": "transform_values(tags, (k, v) -> if(k = 'b', 3, v))"},
    "the last digit": {"level": "level * 1.0000000000000002D"},
    "a letter far back": {"note": "concat(substring(note, 1, 2990), 'y', substring(note, 2992))"},
    "empty for NULL": {"note": "coalesce(note, '')"},
    "NULL for empty": {"note": "nullif(note, '')"},
    "a large number": {"number": "if(number > 9, number - 1, number)"},
}
CHECKSUMS = (table_checksum, content_checksum)
LAYOUTS = {
    "narrower": lambda df: df.withColumn("number", F.col("number").cast("decimal(20,0)")),
    "other name": lambda df: df.withColumnRenamed("note", "Note"),
    "other order": lambda df: df.select(*reversed(df.columns)),
    "one more": lambda df: df.withColumn("extra", F.lit(None).cast("string")),
}


@pytest.mark.parametrize("change", CHANGES)
def test_changed_values(spark, change):
    before = flat(events(spark))
    after = flat(events(spark).withColumns({c: F.expr(e) for c, e in CHANGES[change].items()}))
    for exact in (True, False):
        both = compare_all(spark, {"t": before}, {"a": {"t": before}, "b": {"t": after}}, exact)
        assert {r.candidate: r.equivalent for r in both.collect()} == {"a": True, "b": False}
    for checksum in CHECKSUMS:
        assert checksum(before).first() != checksum(after).first()
    assert multiset_diff(before, after).agg(F.sum("copies_delta")).first()[0] == 0
    assert positional_mismatches(before, after).first().mismatches > 0
    # the checksums take maps as they are
    changed = events(spark).withColumns({c: F.expr(e) for c, e in CHANGES[change].items()})
    for checksum in CHECKSUMS:
        assert checksum(events(spark)).first() != checksum(changed).first()


@pytest.mark.parametrize("copies", [0, 1, 2, 4])
def test_changed_number_of_copies(spark, copies):
    df = flat(events(spark))
    other = df.where("at IS NOT NULL")
    for _ in range(copies):
        other = other.unionAll(df.where("at IS NULL").limit(1))
    assert [r.copies_delta for r in multiset_diff(df, other).collect()] == [copies - 3]
    report = compare_all(spark, {"t": df}, {"o": {"t": other}}).first()
    assert (report.differing_rows, report.candidate_rows) == (abs(copies - 3), 3 + copies)
    for checksum in CHECKSUMS:
        assert checksum(df).first() != checksum(other).first()


@pytest.mark.parametrize("layout", LAYOUTS)
def test_changed_layout(spark, layout):
    before, after = events(spark), LAYOUTS[layout](events(spark))
    assert content_checksum(before).first() != content_checksum(after).first()
    assert schema_diff(before, after) and not schema_diff(before, events(spark))
    row = compare_all(spark, {"t": before}, {"c": {"t": after}}).first()
    assert (row.same_schema, row.equivalent, row.baseline_rows, row.candidate_rows) == (False, False, 6, 6)


def test_row_order_says_nothing(spark):
    df = flat(events(spark))
    shuffled = df.repartition(5).orderBy(F.desc("number"))
    assert multiset_diff(df, shuffled).isEmpty()
    for checksum in CHECKSUMS:
        assert checksum(df).first() == checksum(shuffled).first()
    assert positional_mismatches(df, shuffled).first().mismatches == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id bigint")
    for exact in (True, False):
        report = compare_all(spark, {"empty": empty}, {"other": {"empty": empty}}, exact).first()
        assert report.equivalent and report.baseline_rows == 0
    assert as_set(positional_mismatches(empty, empty)) == [(0, 0, 0)]
    assert table_checksum(empty).first() == (0, "0-0")
    assert content_checksum(empty).first() == (0, "0-0-0-0-0-0")
    one = spark.createDataFrame([(1,)], "id bigint")
    assert as_set(positional_mismatches(empty, one)) == [(0, 1, 1)]


def test_nonfinite_rules_equivalence_out(spark):
    df = spark.sql("SELECT CAST('NaN' AS DOUBLE) AS x")
    for exact in (True, False):
        row = compare_all(spark, {"t": df}, {"same": {"t": df}}, exact).first()
        assert not row.equivalent and row.nonfinite_rows >= 1


def test_null_positions_differ_in_checksum(spark):
    a = spark.sql("SELECT 1 AS x, CAST(NULL AS INT) AS y")
    b = spark.sql("SELECT CAST(NULL AS INT) AS x, 1 AS y")
    twice = a.unionAll(a)
    for checksum in CHECKSUMS:
        assert checksum(a).first() != checksum(b).first()
        assert checksum(twice).first() != checksum(a.limit(0)).first()


PAIRS = {  # rows of the same types that a careless encoding takes for equal
    "signed zero": ("0.0D AS x", "CAST('-0.0' AS DOUBLE) AS x"),
    "signed zero, float": ("CAST(0.0 AS FLOAT) AS x", "CAST('-0.0' AS FLOAT) AS x"),
    "text borders": ("'ab' AS x, 'c' AS y", "'a' AS x, 'bc' AS y"),
    "empty and null text": ("'' AS x, CAST(NULL AS STRING) AS y", "CAST(NULL AS STRING) AS x, '' AS y"),
    "null and zero": ("CAST(NULL AS BIGINT) AS x", "0L AS x"),
    "null and NaN": ("CAST(NULL AS DOUBLE) AS x", "CAST('NaN' AS DOUBLE) AS x"),
    "array borders": ("array(array(1), array(2)) AS x", "array(array(1, 2)) AS x"),
    "null in an array": ("array(1, NULL) AS x", "array(1) AS x"),
    "null and empty map": ("map('a', 1) AS x", "CAST(NULL AS MAP<STRING, INT>) AS x"),
    "null struct": ("named_struct('a', CAST(NULL AS INT)) AS x", "CAST(NULL AS STRUCT<a: INT>) AS x"),
    "bytes": ("X'00' AS x", "X'0000' AS x"),
    "decimals": ("CAST(1.1 AS DECIMAL(30,2)) AS x", "CAST(1.11 AS DECIMAL(30,2)) AS x"),
    "days": ("DATE '2030-01-01' AS x", "DATE '2030-01-02' AS x"),
    "truth": ("true AS x", "false AS x"),
}


@pytest.mark.parametrize("pair", PAIRS)
def test_typed_hashes_tell_apart(spark, pair):
    a, b = (content_checksum(spark.sql(f"SELECT {row}")).first() for row in PAIRS[pair])
    assert a != b and a.row_count == b.row_count == 1


def test_typed_hashes_of_many_columns(spark):
    """More flags than one number holds; each column counts."""
    columns = [F.when(F.col("id") != i, F.lit(1.5)).alias(f"c {i}.") for i in range(70)]
    wide = spark.range(71).select(*columns)
    assert hashed(wide).distinct().count() == 71


def test_map_entries_in_any_order(spark):
    a, b = (spark.sql(f"SELECT map({m}) AS x") for m in ("'a', 1, 'b', 2", "'b', 2, 'a', 1"))
    assert content_checksum(a).first() == content_checksum(b).first()


def test_positional_mismatches_against_brute_force(spark):
    rng = random.Random(7)

    def rows(n):
        return [
            (rng.choice([None, 1, 2, 3, 3, 3, 3]), rng.choice([None, "a", "b", "é"])) for _ in range(n)
        ]

    def key(row):
        return tuple((v is None, v if v is not None else 0) for v in row)

    for n, m in ((0, 3), (40, 40), (200, 170), (150, 300)):
        a, b = rows(n), rows(m)
        x, y = sorted(a, key=key), sorted(b, key=key)
        expected = abs(n - m) + sum(p != q for p, q in zip(x, y))
        left = spark.createDataFrame(a, "k int, v string")
        right = spark.createDataFrame(b, "k int, v string")
        assert as_set(positional_mismatches(left, right)) == [(n, m, expected)]


def test_tolerance(spark):
    schema = "k bigint, x double, n bigint, at timestamp, tags array<int>"
    noon = dt.datetime(2030, 1, 1, 12)
    left = [
        (1, 100.0, 1000, noon, [1]),
        (2, 100.0, 10, noon, [1]),
        (None, None, 1, None, None),
        (4, 1.0, 1, noon, [1]),
        (6, 1.0, 1, noon, [1]),
        (6, 2.0, 1, noon, [1]),
        (7, float("nan"), 0, noon, [1]),
        (8, 1.0, 2**62, noon, [1]),
    ]
    right = [
        (1, 100.9, 1001, noon, [1]),
        (2, 103.0, 99, noon + dt.timedelta(microseconds=1), [2]),
        (None, None, 1, None, None),
        (5, 1.0, 1, noon, [1]),
        (6, 1.0, 1, noon, [1]),
        (7, 1.0, 0, noon, [1]),
        (8, 1.0, 2**62, noon, [1]),
    ]
    found = tolerance_diff(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], 0.01)
    assert as_set(found) == [
        (2, "at", "2030-01-01 12:00:00", "2030-01-01 12:00:00.000001"),
        (2, "n", "10", "99"),
        (2, "tags", "[1]", "[2]"),
        (2, "x", "100.0", "103.0"),
        (4, "only_left", None, None),
        (5, "only_right", None, None),
        (6, "repeated_left", "2", "1"),
        (7, "x", "NaN", "1.0"),
    ]


def test_missing_relation_is_reported(spark):
    spark.range(2).createOrReplaceTempView("ignored")
    spark.sql("CREATE OR REPLACE VIEW default.present AS SELECT 1 AS id")
    tables = database_tables(spark, "default", ["present", "absent"])
    report = compare_all(spark, tables, {"same": tables}).collect()
    assert {row.table_name: row.equivalent for row in report} == {"present": True, "absent": False}
