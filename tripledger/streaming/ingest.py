"""Month files as a stream: each file is cleaned, added to the facts, and only the dates it
touches are recomputed, however old they are."""

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tripledger.contract import Bounds
from tripledger.operators.facts import PARTITION, fct_trips, write_facts
from tripledger.functions.numeric import combine_sums
from tripledger.operators.metrics import daily_from_parts, daily_metrics, daily_parts
from tripledger.operators.refresh import facts_of_dates, touched_dates
from tripledger.operators.staging import classify_rejects, stage, typed_trips
from tripledger.sources.workdir import materialize


def read_drops(
    spark: SparkSession, inbox: str, schema: T.StructType, files_per_batch: int = 1000
) -> DataFrame:
    """Stream the Parquet files that arrive in a folder, in batches of bounded size."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .parquet(inbox)
    )


def _run(
    stream: DataFrame, mode: str, checkpoint: str, sink: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _replace(df: DataFrame, path: str) -> None:
    """Write one batch's folder, replacing what an interrupted attempt left there."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The newest version of each key among the ``batch=<n>`` folders of a table."""
    versions = spark.read.parquet(path)
    columns = [name for name in versions.columns if name not in (*keys, "batch")]
    newest = F.max_by(F.struct(*columns), F.col("batch")).alias("_newest")
    return versions.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def stream_ingest(
    trips: DataFrame,
    dim: DataFrame,
    target: str,
    bounds: Bounds = Bounds(),
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Maintain ``<target>/facts`` and ``<target>/daily`` from a stream of raw trips.

    Batches may be delivered twice, so each one owns a folder that a repeat overwrites. The
    daily table keeps one version of a date per batch; ``latest`` picks the newest.
    """

    def one_batch(raw: DataFrame, batch: int) -> None:
        spark = raw.sparkSession
        added = fct_trips(stage(raw, bounds), dim)
        write_facts(added, f"{target}/facts/batch={batch}", "overwrite")
        folders = [T.StructField("batch", T.LongType()), T.StructField(PARTITION, T.DateType())]
        schema = T.StructType([*added.schema, *folders])
        facts = spark.read.schema(schema).parquet(f"{target}/facts")
        facts = facts.where(F.col("batch") <= batch)
        dates = materialize(touched_dates(facts.where(F.col("batch") == batch)), "touched")
        affected = facts_of_dates(facts, dates)
        _replace(daily_metrics(affected), f"{target}/daily/batch={batch}")

    return _run(trips, "append", checkpoint or f"{target}/checkpoints/ingest", one_batch)


def stream_rejects(
    trips: DataFrame, target: str, bounds: Bounds = Bounds()
) -> StreamingQuery:
    """Running accepted and rejected counts per reason. The state has one row per reason, and
    each batch stores the whole result; ``latest`` with key ``reject_reason`` reads it."""
    reason = F.coalesce("reject_reason", F.lit("accepted")).alias("reject_reason")
    counts = (
        classify_rejects(typed_trips(trips), bounds)
        .groupBy(reason)
        .agg(F.count(F.lit(1)).alias("trip_count"))
    )

    def one_batch(rows: DataFrame, batch: int) -> None:
        _replace(rows, f"{target}/rejects/batch={batch}")

    return _run(counts, "complete", f"{target}/checkpoints/rejects", one_batch)


def stream_daily(
    trips: DataFrame, dim: DataFrame, target: str, bounds: Bounds = Bounds()
) -> StreamingQuery:
    """Daily metrics in ``<target>/daily_state`` from running partial sums, with no watermark: a late
    row always counts. ``latest`` with key ``date`` reads them.

    The partial sums are kept in whole months. A batch adds its own to the newest version of the
    months it touches and writes these anew, below ``daily_parts/batch=<n>``; ``daily_heads/batch=<n>``
    names the newest version of every month, one row each. So a batch reads its own rows, the heads of
    the batch before and the months it touches, however many batches there were. A repeated batch
    starts from the heads of the batch before again, and replaces its own folders.
    """

    def one_batch(raw: DataFrame, batch: int) -> None:
        spark = raw.sparkSession
        added = materialize(daily_parts(fct_trips(stage(raw, bounds), dim)), "parts")
        month = F.trunc("date", "MM").alias("month")
        # months and their heads: the calendar bounds them
        touched = [row.month for row in added.select(month).distinct().collect()]
        heads = _heads(spark, target, batch - 1)
        whole = added
        if known := {m: heads[m] for m in touched if m in heads}:
            whole = combine_sums(added.unionByName(_versions(spark, target, added.schema, known)), ["date"])
        parts = f"{target}/daily_parts/batch={batch}"
        whole = whole.select("*", month).repartition("month")
        whole.write.mode("overwrite").option("compression", "zstd").partitionBy("month").parquet(parts)
        _replace(daily_from_parts(spark.read.schema(added.schema).parquet(parts)), f"{target}/daily_state/batch={batch}")
        now = heads | {m: batch for m in touched}
        _replace(spark.createDataFrame(list(now.items()), HEADS), f"{target}/daily_heads/batch={batch}")

    return _run(trips, "append", f"{target}/checkpoints/daily", one_batch)


HEADS = "month date, head bigint"


def _heads(spark: SparkSession, target: str, batch: int) -> dict[dt.date, int]:
    """The batch that holds the newest version of each month, after ``batch``."""
    if batch < 0:
        return {}
    return dict(map(tuple, spark.read.schema(HEADS).parquet(f"{target}/daily_heads/batch={batch}").collect()))


def _versions(spark: SparkSession, target: str, schema: T.StructType, heads: dict[dt.date, int]) -> DataFrame:
    """The partial sums of some months, in the versions that ``heads`` names."""
    folders = [f"{target}/daily_parts/batch={batch}/month={month}" for month, batch in heads.items()]
    return spark.read.schema(schema).parquet(*folders)
