"""One registered query per operator, each over its whole table with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm import (
    bm25,
    fingerprints,
    language,
    manifest,
    mixing,
    packing,
    pii,
    quality,
    resample,
    secrets,
    simhash,
    toxicity,
    warc,
)
from tripledger.sources.workdir import fresh_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and offending spans of every document."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Only for the registered query and the pipeline over made-up data; real data need a secret key.
DEMO_KEY = b"tripledger demonstration key"


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and where they stand in for what."""
    return pii.pseudonymise_documents(table(spark, sf_dir, "documents"), DEMO_KEY)


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence and place of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document. A source is an owner, and a document a repository."""
    return secrets.report(table(spark, sf_dir, "documents"), owner_col="source", repo_col="doc_id")


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, and the mixture it is the largest part of."""
    return language.identify_documents(table(spark, sf_dir, "documents"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    path = fresh_dir(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    return warc.archived_pages(spark, path)


ORACLE_SQL["op10_warc"] = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), sized AS (
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p
), grouped AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to
FROM grouped
"""


@query
def op8_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 20, itself among them."""
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where("doc_id % 20 = 0"))


ORACLE_SQL["op8_bm25"] = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w
    FROM documents
), tf AS (
    SELECT doc_id, w, count(*) AS n FROM words GROUP BY ALL
), size AS (
    SELECT d.doc_id, coalesce(sum(n), 0) AS dl FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY 1
), mean AS (
    SELECT avg(dl) AS avgdl, count(*) AS docs FROM size
), idf AS (
    SELECT w, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, mean GROUP BY w, docs
), scores AS (
    SELECT q.doc_id AS query_id, d.doc_id,
        round(sum(q.n * idf * d.n * 2.2 / (d.n + 1.2 * (0.25 + 0.75 * dl / avgdl))), 8) AS score
    FROM tf q JOIN idf USING (w) JOIN tf d USING (w) JOIN size s ON s.doc_id = d.doc_id, mean
    WHERE q.doc_id % 20 = 0 GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores
)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document for the texts of the benchmark, and the draw."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike they are."""
    return fingerprints.edit_and_compare(table(spark, sf_dir, "documents"))


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, a seventh of them tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest.manifest(table(spark, sf_dir, "documents"), tampered=tampered)
