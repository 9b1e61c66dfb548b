"""Completeness and uniformity of groups, and pivots over a fixed set of members.

All of them reduce each group to a few counters before the shuffle, so a group that holds a
large share of the rows costs no more than a small one.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions.numeric import failures
from tripledger.operators.compare import comparable

OTHER = "(other)"


def group_completeness(
    df: DataFrame, group: Sequence[str], member: str, expected: Sequence[str]
) -> DataFrame:
    """Members that a group has not exactly once: (group, member, occurrences).

    Rows whose member is not among the expected ones are counted as ``(other)``.
    """
    column = F.col(member)
    listed = F.coalesce(column.isin(list(expected)), F.lit(False))
    counts = df.groupBy(*group).agg(
        *(failures(column == name).alias(f"_m{i}") for i, name in enumerate(expected)),
        failures(~listed).alias("_other"),
    )

    def entry(name: str, count: str) -> Column:
        return F.struct(F.lit(name).alias("member"), F.col(count).alias("occurrences"))

    entries = [entry(name, f"_m{i}") for i, name in enumerate(expected)] + [entry(OTHER, "_other")]
    wanted = F.when(F.col("member") == OTHER, 0).otherwise(1)
    return counts.select(*group, F.inline(F.array(*entries))).where(
        F.col("occurrences") != wanted
    )


def uniform_within_group(
    df: DataFrame, group: Sequence[str], fields: Sequence[str], allow_null: bool = True
) -> DataFrame:
    """Fields that are not the same in every row of their group, as (group, field, lowest,
    highest, nulls). NULL equals NULL; without ``allow_null`` any NULL is a finding. An empty
    ``group`` checks the whole table."""
    rows = df.select(*group, *(comparable(df, name).alias(f"_v{i}") for i, name in enumerate(fields)))
    stats = []
    for i, _ in enumerate(fields):
        value = F.col(f"_v{i}")
        stats += [
            F.min(value).alias(f"_lo{i}"),
            F.max(value).alias(f"_hi{i}"),
            failures(value.isNull()).alias(f"_null{i}"),
        ]
    grouped = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *stats)
    entries = [
        F.struct(
            F.lit(name).alias("field"),
            F.col(f"_lo{i}").alias("lowest"),
            F.col(f"_hi{i}").alias("highest"),
            F.col(f"_null{i}").alias("nulls"),
        )
        for i, name in enumerate(fields)
    ]
    partly_null = (F.col("nulls") > 0) & (F.col("nulls") < F.col("_n"))
    null_finding = partly_null if allow_null else F.col("nulls") > 0
    return (
        grouped.select(*group, "_n", F.inline(F.array(*entries)))
        .where((F.col("lowest") != F.col("highest")) | null_finding)
        .drop("_n")
    )


def pivot_members(
    df: DataFrame, row: str, member: str, expected: Sequence[str], value: str, digits: int = 3
) -> DataFrame:
    """One row per ``row`` value and one column per member: the value, rounded for display. Where
    a cell has several values, the largest shows. What the columns cannot show is counted:
    ``other_rows``, rows whose member is not listed, and ``repeated_rows``, rows that share a cell
    with another one."""
    listed = F.coalesce(F.col(member).isin(list(expected)), F.lit(False))
    cells, counts = [], []
    for i, name in enumerate(expected):
        here = F.col(member) == F.lit(name)
        cells.append(F.max(F.when(here, F.col(value))).alias(f"_cell{i}"))
        counts.append(failures(here).alias(f"_rows{i}"))
    wide = df.groupBy(row).agg(*cells, *counts, failures(~listed).alias("other_rows"))
    repeated = sum((F.greatest(F.col(f"_rows{i}") - 1, F.lit(0)) for i in range(len(expected))), F.lit(0))
    return wide.select(
        row,
        *(F.round(F.col(f"_cell{i}"), digits).alias(name) for i, name in enumerate(expected)),
        "other_rows",
        repeated.cast("bigint").alias("repeated_rows"),
    )


def max_per_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Largest value per group, e.g. to scale a display."""
    return df.groupBy(group).agg(F.max(value).alias(f"max_{value}"))
