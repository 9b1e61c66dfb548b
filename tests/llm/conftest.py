import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table of (doc_id, text[, lang[, source]]) tuples."""

    def make(rows, *, extra=()):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, None, None)[:4]
            full.append((doc_id, text, lang, source, len(text) if text is not None else None))
        df = spark.createDataFrame(full, DOCS)
        for name in extra:
            df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return make
