"""The registered queries: their contracts, and their SQL where they have one."""

import pytest

import __spark_entry__ as entry
from suite.check import connect, rows
from tripledger.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op5_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_pii": ["doc_id", "text", "n_found"],
    "op7_packing": ["doc_id", "piece", "start", "length", "bin_id", "capacity", "offset"],
    "op8_bm25": ["query_id", "rank", "doc_id", "score"],
    "op9_simhash": ["doc_id", "fingerprint", "component_id"],
    "op11_resampling": ["doc_id", "n_features", "weight", "score", "rank"],
    "op12_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op13_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op10_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
}


def test_registered():
    assert set(COLUMNS) == set(QUERIES) and set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name] or set(COLUMNS[name]) <= set(df.columns)
    got = df.collect()
    assert got
    if name in ORACLE_SQL:
        result = connect(SF).execute(ORACLE_SQL[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, result.fetchall())
