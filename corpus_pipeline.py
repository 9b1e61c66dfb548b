"""The corpus pipeline: each stage reads what the one before it wrote.

All stages but the last return the columns of documents. Each works on every row that its
predecessor kept: toxic documents go, one document of each near-duplicate group stays, personal
data become pseudonyms, sources are mixed to their weights (a document taken twice has two rows),
and the mix is packed into sequences.
"""

from pyspark.sql import DataFrame, SparkSession

from tripledger.llm import mixing, packing, pii, simhash, toxicity
from tripledger.llm.queries import DEMO_KEY, table
from tripledger.sources.workdir import fresh_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs, words=4, bits=4)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of their format."""
    return pii.replace_in_documents(docs, DEMO_KEY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and place of every piece of the mix."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", one_of_each_group),
    ("pii", with_pseudonyms),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learned scores, fingerprints and keyed permutations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
