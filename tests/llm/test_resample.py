"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tripledger.llm import resample

SF = "/root/testdata/sf0.001"
BUCKETS = 10000


def features(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def slow(docs, target):
    """(id, n_features, weight, score, rank) of (id, text) pairs."""
    bucket = lambda f: zlib.crc32(f.encode()) % BUCKETS
    s, t = (Counter(bucket(f) for _, x in rows for f in features(x)[1]) for rows in (docs, target))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + BUCKETS) / ((s[b] + 1) * (all_t + BUCKETS)))) for b in range(BUCKETS)]
    out = []
    for key, text in docs:
        n, own = features(text)
        weight = sum(gain[bucket(f)] for f in own)
        h = int(hashlib.sha256(f"42:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((key, len(own), weight, score, n >= 20))
    order = sorted((-score, key is None, key or 0, i) for i, (key, _, _, score, able) in enumerate(out) if able)
    rank = {i: r + 1 for r, (_, _, _, i) in enumerate(order[: len(order) * 5 // 100])}
    return [(*row[:4], rank.get(i)) for i, row in enumerate(out)]


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_given_table(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = slow(rows, [(None, r.text) for r in target.collect()])
    assert result(resample.resample(docs, target)) == sorted(want, key=repr)
    assert any(w[4] for w in want)


def test_odd_rows(spark, documents):
    long = " ".join(f"Wörd{i % 977} x" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \x00 - "), (None, "eins zwei"), (None, long[:400]), (4, long), (4, long), (5, "a" * 100000)]
    rows += [(i, f"{long[i : i + 300]} q") for i in range(10, 130)] + [(200, long[:300])] * 30
    docs = documents(rows, extra=["score", "rank", "x", "row", "__part"])
    target = documents([(1, "wörd1 X wörd2 x"), (2, None)])
    assert result(resample.resample(docs, target)) == sorted(slow(rows, [(0, "wörd1 X wörd2 x")]), key=repr)


def test_empty(spark, documents):
    some = [(i, "one two three " * 10) for i in range(40)]
    assert result(resample.resample(documents([]), documents(some))) == []
    assert result(resample.resample(documents(some), documents([]))) == sorted(slow(some, []), key=repr)


@pytest.mark.parametrize("limit", [7, 64, 1 << 18])
def test_pieces(limit):
    """However texts are cut and batched, the n-grams are the same."""
    texts = ["one two  three four five " * 9, "", "six", "Sé.ven eight", "x" * 50 + " y"]
    got = Counter()
    for number, strings in resample.batches([t.encode() for t in texts], limit):
        got.update((int(n), strings.bytes(i).decode()) for i, n in enumerate(number))
    assert got == Counter((i, f) for i, t in enumerate(texts) for f in features(t)[1])


def test_table():
    """Hashes and CRCs are the known ones; strings with the same hash are told apart by bytes."""
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in rng.integers(1, 70, 3000)] * 2
    start = np.cumsum([0, *map(len, parts)])[:-1]
    strings = resample.Strings(b"".join(parts), start, np.array(list(map(len, parts))))
    assert strings.hashes().tolist() == [xxhash.xxh64_intdigest(p) for p in parts]
    assert strings.crcs(np.arange(len(parts))).tolist() == [zlib.crc32(p) for p in parts]
    for hashes in (None, np.zeros(len(parts), np.uint64), strings.hashes() & np.uint64(7)):
        if hashes is not None:  # few starting places: keep the number of collisions small
            strings = resample.Strings(strings.data, start[:300], strings.size[:300])
            hashes = hashes[:300]
        own = parts[: len(strings.start)]
        table = resample.Interned(strings, BUCKETS, hashes)
        slots = {}
        for p, s in zip(own, table.slot.tolist()):
            assert slots.setdefault(p, s) == s
            assert table.bucket[s] == zlib.crc32(p) % BUCKETS and table.count[s] == own.count(p)
        assert len(set(slots.values())) == len(slots)
