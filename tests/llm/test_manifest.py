"""The manifest against trees built in plain Python; rank queries against sorting."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripledger.llm import manifest

SF = "/root/testdata/sf0.01"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tampered(row):
    if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
        return (*row[:3], row[3] + 1, row[4])
    return row


def slow(rows):
    groups, beside = defaultdict(list), defaultdict(list)
    for i, r in enumerate(rows):
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), i))

    def reduce(nodes):
        while len(nodes) > 1:
            level = []
            for i in range(0, len(nodes), 2):
                run = nodes[i : i + 2]
                for j, (_, members) in enumerate(run):
                    for m in members:
                        beside[m].append((j, run[1 - j][0]) if len(run) == 2 else (0, None))
                level.append((sha(*(d for d, _ in run)), [m for _, members in run for m in members]))
            nodes = level
        return nodes[0]

    tops = {g: reduce([(d, [i]) for *_, d, i in sorted(groups[g])]) for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode()))}
    subroots = {g: d for g, (d, _) in tops.items()}
    root = reduce(list(tops.values()))[0] if tops else None
    out = []
    for i, r in enumerate(rows):
        d = leaf(tampered(r))
        for left, b in beside[i]:
            d = sha(d) if b is None else sha(b, d) if left else sha(d, b)
        out.append((r[0], leaf(r), subroots[r[2]], root, sha(*(b for _, b in beside[i] if b)), d, d == root))
    return out


def check(docs):
    got = manifest.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = slow([tuple(r) for r in docs.select(*FIELDS).collect()])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    return want


def test_given_table(spark):
    want = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert 0 < sum(not w[6] for w in want) < len(want)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_sizes(documents, monkeypatch, levels):
    """Groups of one leaf to a few dozen, ids far apart and below zero, several arrays deep."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "FAN", 1 << levels)
    rows = [((i * 7919 - 300) * (1 << (i % 40)), f"t{i}", f"l{n}" if n else None, "s") for n in range(14) for i in range(n, 3 * n + 1)]
    check(documents(rows))


def test_odd_rows(documents):
    rows = [(1, None), (2, "", "de"), (None, "x", "de"), (None, "x", "de"), (None, "y", None), (3, "a" * 300000, "", "é"), (3, "b", "")]
    rows += [(9, "same", "de", "s")] * 5 + [(9, f"other {i}", "de") for i in range(5)] + [(-(1 << 63), "low", "de"), ((1 << 63) - 1, "high", "de")]
    check(documents(rows, extra=["grp", "id", "rank", "leaf", "root", "size", "path"]))
    check(documents([]))
    check(documents([(5, "alone")]))


@pytest.mark.parametrize("count", [0, 1, 300, 4095, 4096, 50000, 65536])
def test_ranks(count):
    rng = np.random.default_rng(count)
    low = rng.choice(1 << 16, count, replace=False)
    often = rng.choice(low, min(count, 20), replace=False)
    extra = np.column_stack([often, rng.integers(1, 9, len(often))]).astype("<i8")
    ranks = manifest.Ranks(manifest.pack(low), extra.tobytes())
    assert ranks.members().tolist() == sorted(low.tolist())
    assert len(manifest.pack(low)) <= 8192
    rows = np.zeros(1 << 16, dtype=np.int64)
    rows[low] = 1
    rows[extra[:, 0]] += extra[:, 1]
    asked = np.arange(1 << 16)
    assert (ranks.rank(asked) == np.cumsum(rows) - rows).all()
    assert (ranks.rows(low) == rows[low]).all()


def test_partial_bitmaps(documents, monkeypatch):
    """Bitmaps passed on before the end of a task are merged, with ids seen in several."""
    monkeypatch.setattr(manifest, "HELD", 10)
    rows = [(i % 200 * 1000, f"t{i}", "a" if i % 3 else None) for i in range(500)]
    check(documents(rows).repartition(7))
