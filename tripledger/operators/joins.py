"""Joining a large table to a lookup."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripledger.sources.sinks import salts, with_salt

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(
    lookup: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure a lookup: its rows, and its bytes in the form a broadcast holds them (eight per
    column, and the length of variable-size values)."""
    width = F.lit(8 * len(lookup.columns))
    for field in lookup.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.octet_length(F.to_json(F.struct(field.name)))
    size = lookup.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")
    ).first()
    return size.n <= max_rows and size.bytes <= max_bytes


def splits_skew(spark: SparkSession) -> bool:
    """Whether adaptive execution splits skewed join partitions in this session."""
    needed = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(spark.conf.get(name) == "true" for name in needed)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[tuple[str, str]],
    how: str = "inner",
    small: bool | None = None,
) -> DataFrame:
    """Join ``rows`` to a lookup on pairs of (row column, lookup column).

    Nothing runs here. A lookup that the caller has measured (``fits_broadcast``) is broadcast,
    and ``rows`` stays where it is. Otherwise Spark decides by the sizes it knows, broadcasting up
    to its own checked limit. A key that holds a large share of ``rows`` must not end up in one
    task of a shuffled join: adaptive execution splits such partitions, and where it is switched
    off the key is salted, with one copy of the lookup per salt. All ways give the same rows.
    Column names of the two sides must differ. ``how`` keeps or filters ``rows`` (inner, left,
    left_semi, left_anti).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    keys = [F.col(left) == F.col(right) for left, right in on]
    if small:
        return rows.join(F.broadcast(lookup), keys, how)
    if splits_skew(rows.sparkSession):
        return rows.join(lookup, keys, how)
    salted = with_salt(rows, "_salt")
    last = F.lit(salts(rows.sparkSession) - 1)
    copies = lookup.withColumn(
        "_lookup_salt", F.explode(F.sequence(F.lit(0), last).cast("array<bigint>"))
    )
    joined = salted.join(copies, [*keys, F.col("_salt") == F.col("_lookup_salt")], how)
    return joined.drop("_salt", "_lookup_salt")


def flag_unknown(
    rows: DataFrame, ids: DataFrame, id_column: str, column: str, flag: str, small: bool | None = None
) -> DataFrame:
    """Add a flag that is TRUE where ``column`` has no match in ``ids`` (NULL has none).

    ``ids`` must be distinct and not NULL, so that no row of ``rows`` is repeated.
    """
    known = ids.select(F.col(id_column).alias("_known"))
    joined = lookup_join(rows, known, [(column, "_known")], "left", small)
    return joined.withColumn(flag, F.col("_known").isNull()).drop("_known")


def known_ids(lookup: DataFrame, column: str) -> DataFrame:
    """The ids of a lookup, once each and without NULL."""
    return lookup.select(column).where(F.col(column).isNotNull()).distinct()
