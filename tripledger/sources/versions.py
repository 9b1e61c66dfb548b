"""Where a stored table lies when parts of it are older than others.

A location names folders, one per line, each with the conditions that its rows must meet, after
tabs. A table that was written whole is one folder without conditions. One whose newer version
replaced some months names the new folder first and the older ones with those months left out, so
nothing that did not change is written again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def parts(location: str) -> list[tuple[str, list[str]]]:
    """(folder, conditions) of each part of a location."""
    split = (line.split("\t") for line in location.split("\n"))
    return [(folder, conditions) for folder, *conditions in split]


def location(*listed: tuple[str, list[str]]) -> str:
    return "\n".join("\t".join([folder, *conditions]) for folder, conditions in listed)


def replaced(newer: str, older: str, gone: str) -> str:
    """The location of a table whose rows that meet the condition ``gone`` have a newer version.

    Only a single condition on storage columns leaves whole folders unread.
    """
    rest = f"coalesce(NOT ({gone}), true)"
    return location(*parts(newer), *((folder, [*c, rest]) for folder, c in parts(older)))


def extended(older: str, newer: str) -> str:
    """The location of a table to which rows were added."""
    return location(*parts(older), *parts(newer))


def read_location(spark: SparkSession, where: str, schema: T.StructType) -> DataFrame:
    """All parts, with the columns of ``schema``, which has those that conditions mention."""
    out = None
    for folder, conditions in parts(where):
        rows = spark.read.schema(schema).parquet(folder)
        for condition in conditions:
            rows = rows.where(condition)
        rows = rows.select(*schema.names)
        out = rows if out is None else out.unionAll(rows)
    return out
