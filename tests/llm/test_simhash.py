"""SimHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from tests.conftest import as_set
from tripledger.llm import simhash


def slow_fingerprint(text, words=4):
    tokens = (text or "").encode()
    tokens = bytes(c + 32 if 65 <= c <= 90 else c for c in tokens)
    tokens = [t for t in tokens.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if t]
    if not tokens:
        return 0
    shingles = [tokens[i : i + words] for i in range(len(tokens) - words + 1)] or [tokens]
    hashes = [xxhash.xxh64(b" ".join(s), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, bits=4):
    values = np.array(sorted(set(fps)), dtype=np.uint64)
    root = {int(v): int(v) for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v in enumerate(values):
        for w in values[:i][np.bitwise_count(values[:i] ^ v) <= bits]:
            a, b = find(int(v)), find(int(w))
            root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


def expected(rows, words=4, bits=4):
    fps = [slow_fingerprint(t, words) for _, t, *_ in rows]
    roots = slow_components(fps, bits)
    ids = {}
    for (doc_id, *_), fp in zip(rows, fps):
        if doc_id is not None:
            ids[roots[fp]] = min(doc_id, ids.get(roots[fp], doc_id))
    return [(doc_id, f"{fp:016x}", ids.get(roots[fp])) for (doc_id, *_), fp in zip(rows, fps)]


def corpus(seed=1, groups=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉßñ") for _ in range(rng.randint(1, 6)))
    rows, doc_id = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(1, 400))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((doc_id * 7 % 1009, rng.choice([" ", "\n", "\t "]).join(copy)))
            doc_id += 1
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (None, "only here"), (rows[1][0], rows[1][1])]


@pytest.mark.parametrize("segments, crowd", [(2, 2000), (3, 2), (None, 2000)])
def test_all_links(spark, documents, segments, crowd):
    rows = corpus()
    rows_df, groups = simhash.classes(documents(rows), crowd=crowd, segments=segments)
    got = rows_df.join(groups, "fp").selectExpr("id", "lpad(lower(hex(fp)), 16, '0')", "component_id")
    assert as_set(got) == sorted(expected(rows), key=repr)


def test_chain_and_dense_ball(spark):
    """Fingerprints in one ball, a chain of single flips, and far ones."""
    rng = random.Random(3)
    ball = [0x0123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(150)]
    chain = [((1 << 64) - 1) >> (4 * i) for i in range(12)]
    far = [rng.getrandbits(64) for _ in range(100)]
    values = sorted({*ball, *chain, *far})
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = slow_components(values)
    for crowd in (3, 2000):
        edges = simhash.links(df, crowd=crowd)
        found = {r.node & (2**64 - 1): r.root for r in simhash.components(edges).collect()}
        for a in values:
            for b in values[:60]:
                same = found.get(a, a) == found.get(b, b)
                assert same == (want[a] == want[b])


def test_buckets_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_chain_and_dense_ball(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keep_one(spark, documents):
    rows = corpus(seed=5)
    rows += [(rows[3][0], "Another text under the same id, far away"), (None, "only here")]
    got = simhash.keep_one(documents(rows, extra=["fp", "root", "id", "row", "n"]))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "root", "id", "row", "n"]
    table = {}
    for (doc_id, text), (_, _, component) in zip(rows, expected(rows)):
        table.setdefault((component, slow_components([slow_fingerprint(t) for _, t in rows])[slow_fingerprint(text)]), []).append((doc_id is None, doc_id or 0, text or "", text))
    kept = [(r.doc_id, r.text or "") for r in got.collect()]
    best = [min((a, b, c) for a, b, c, _ in v) for v in table.values()]
    assert sorted(kept, key=repr) == sorted([(None if a else b, c) for a, b, c in best], key=repr)


def test_empty(spark, documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.keep_one(documents([])).collect() == []


def test_repeated_rows_are_copies(spark, documents):
    rows = [(1, "a b c d e f")] * 5 + [(2, "a b c d e f")]
    assert as_set(simhash.near_duplicates(documents(rows)).select("doc_id", "component_id")) == [(1, 1)] * 5 + [(2, 1)]
    assert as_set(simhash.keep_one(documents(rows)).select("doc_id")) == [(1,)]
