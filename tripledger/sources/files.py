"""Facts about files: manifests, changes and storage size."""

import hashlib
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.operators.compare import content_columns, hashed

RANGE = 64 * 2**20
ONE_VALUE = 2_000_000_000  # Spark holds no longer value than 2 GiB
ARROW_STORES = ("file", "s3", "s3a", "gs")  # pyarrow opens them without further libraries


def file_manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Path, size and SHA-256 of each file's bytes, as any other tool computes it.

    A hash of one file is one chain of steps, so a task takes a file, in blocks of bounded size;
    files go to tasks one by one. For files so large that this takes too long there is
    ``range_manifest``. In stores that pyarrow may not reach, a file of up to 2 GB is one value of a
    task, and a larger one fails.
    """
    files, known = _listed(spark, paths)
    size = F.col("length")
    small = size <= (RANGE if known else F.lit(2**62))
    whole = files.where(small).select("path", size.alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if not known:
        return whole
    large = files.where(~small).select("path", size.alias("bytes"), F.lit(0).cast("long").alias("start"), size.alias("end"))
    return whole.unionAll(_dealt(large).select("path", "bytes", F.col("digest").alias("sha256")))


def range_manifest(spark: SparkSession, paths: Sequence[str], piece: int = RANGE) -> DataFrame:
    """Path, size and ``ranges_sha256`` of each file: the SHA-256 of the hexadecimal SHA-256 of its
    ranges of ``piece`` bytes, joined in order, for files of any size.

    Ranges are dealt to tasks and read in blocks by pyarrow. In stores that may be open to Spark only,
    files of up to 2 GB are one value of a task.
    """
    files, known = _listed(spark, paths)
    limit = piece if known else max(piece, ONE_VALUE)
    size = F.col("length")
    digest = _value_digest(F.col("content"), size, piece).alias("ranges_sha256")
    whole = files.where(size <= limit).select("path", size.alias("bytes"), digest)
    starts = F.explode(F.sequence(F.lit(0), size - 1, F.lit(piece))).alias("start")
    ranges = files.where(size > limit).select("path", size.alias("bytes"), starts)
    ranges = ranges.withColumn("end", F.least(F.col("start") + piece, F.col("bytes")))
    digests = F.array_sort(F.collect_list(F.struct("start", "digest")))["digest"]
    joined = F.sha2(F.array_join(digests, ""), 256).alias("ranges_sha256")
    return whole.unionAll(_dealt(ranges).groupBy("path", "bytes").agg(joined))


def _listed(spark: SparkSession, paths: Sequence[str], recursive: bool = False) -> tuple[DataFrame, bool]:
    """The files, and whether pyarrow opens their stores."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(list(paths))
    return files, all(re.match(r"\w+", name)[0] in ARROW_STORES for name in files.inputFiles())


def _dealt(ranges: DataFrame) -> DataFrame:
    """``digest`` of each range (path, bytes, start, end). They are few and tiny rows of much work
    each: a number of partitions keeps them from being merged."""
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks, "path", "start").mapInArrow(
        _range_digests(), "path string, bytes long, start long, end long, digest string"
    )


def parquet_layouts(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """(root, path, layout) of every Parquet file below some files or folders, ``root`` being the one
    it was found through and ``layout`` equal for files of the same columns, types and partition
    columns. Tasks read the footers. None where pyarrow may not reach the store."""
    found, known = _listed(spark, paths, recursive=True)
    found = found.where(~F.col("path").rlike("/_[^/]*$"))  # summaries of other files
    return found.select("path").mapInArrow(_layouts(paths), "root string, path string, layout string") if known else None


def _layouts(paths: Sequence[str]) -> Callable:
    opened = _opener()
    bare = re.compile(r"^\w+:(//[^/]*)?(?=/)")
    roots = {bare.sub("", path).rstrip("/"): path for path in paths}

    def root_of(path: str) -> tuple[str | None, list[str]]:
        inside, folders = bare.sub("", path), []
        while inside and inside not in roots:
            inside, _, name = inside.rpartition("/")
            folders.append(name)
        return roots.get(inside), [name.split("=")[0] for name in folders[:0:-1] if "=" in name]

    def layout(path: str, partitions: list[str]) -> str:
        with opened(path) as file:
            footer = pq.read_metadata(file)
        # behind the line that names the object
        columns = str(footer.schema).split("\n", 1)[1]
        own = (footer.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata", b"")
        return hashlib.sha256("\0".join([columns, own.decode(), *partitions]).encode()).hexdigest()

    def with_layouts(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                root, partitions = root_of(path)
                rows.append({"root": root, "path": path, "layout": layout(path, partitions)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string()) for c in ("root", "path", "layout")]))

    return with_layouts


def _value_digest(content: Column, size: Column, piece: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(piece))
    digests = F.transform(starts, lambda i: F.sha2(F.substring(content, (i + 1).cast("int"), F.lit(piece)), 256))
    return F.sha2(F.array_join(digests, ""), 256)


def _opener() -> Callable:
    """What opens a file in a task. A function within a function travels with its task."""

    def opened(path: str):
        scheme, store, inside = re.fullmatch(r"(\w+):(?://([^/]*))?(/.*)", path).groups()
        if scheme == "file":
            return pafs.LocalFileSystem().open_input_file(inside)
        system, root = pafs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{store or ''}/")
        return system.open_input_file(root.rstrip("/") + inside)

    return opened


def _range_digests() -> Callable:
    opened = _opener()

    def digest(path: str, start: int, end: int) -> str:
        found = hashlib.sha256()
        with opened(path) as file:
            file.seek(start)
            while start < end:
                block = file.read(min(end - start, 4 * 2**20))
                if not block:
                    raise OSError(f"{path} ends at {start}, before {end}")
                found.update(block)
                start += len(block)
        return found.hexdigest()

    def with_digests(batches):
        for batch in batches:
            digests = [digest(r["path"], r["start"], r["end"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "digest"])

    return with_digests


def table_manifest(df: DataFrame, part: Column | None = None) -> DataFrame:
    """Row count and content checksum per file behind a table scan, or per ``part``, an
    expression over the file path such as a partition folder.

    The checksum adds up row hashes, so one large file is read by many tasks.
    """
    path = F.col("_metadata.file_path") if part is None else part
    return hashed(df, path.alias("path")).groupBy("path").agg(*content_columns("h0", "h1"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each path of two manifests with its status: added, removed, changed or unchanged."""
    compared = [name for name in before.columns if name != "path"]
    old = before.select("path", F.struct(*compared).alias("old"))
    new = after.select("path", F.struct(*compared).alias("new"))
    status = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old") != F.col("new"), "changed")
        .otherwise("unchanged")
    )
    return old.join(new, "path", "full_outer").select("path", status.alias("status"))


def storage_stats(spark: SparkSession, tables: dict[str, str], pattern: str = "*.parquet") -> DataFrame:
    """Files and MiB per stored table, from file listings alone (no data is read)."""
    listings = None
    for name, path in tables.items():
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern)
            .load(path)
            .select(F.lit(name).alias("table_name"), "length")
        )
        listings = files if listings is None else listings.unionAll(files)
    return listings.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("files"), (F.sum("length") / 1024.0**2).alias("size_mib")
    )
