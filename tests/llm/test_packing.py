"""Packing: best fit against a plain search, whole pieces, bins within their lengths."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tripledger.llm import packing


def slow_best_fit(sizes, lengths, overhead):
    bins = []  # [opened length, [(piece, offset)], used]
    place, remaining = [], sum(sizes)
    for size in sizes:
        fits = [(b[0] - b[2] - size, i) for i, b in enumerate(bins) if b[0] - b[2] >= size]
        if fits:
            room = min(f[0] for f in fits)
            which = None, room
            i = max((b[3], i) for r, i in fits if r == room for b in [bins[i]])[1]
        else:
            c = min((c for c in lengths if c >= size), key=lambda c: ((c + overhead) / min(c, max(remaining, size)), c))
            bins.append([c, [], 0, 0])
            i = len(bins) - 1
        place.append((i, bins[i][2]))
        bins[i][2] += size
        bins[i][3] = len(place)
        remaining -= size
    return place, [min(c for c in lengths if c >= b[2]) for b in bins]


@pytest.mark.parametrize("seed", range(20))
def test_best_fit(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(5, 60), rng.randint(1, 4)))
    sizes = sorted((rng.randint(1, lengths[-1]) for _ in range(rng.randint(0, 80))), reverse=True)
    bins, offsets, final = packing.best_fit(np.array(sizes, np.int64), lengths, 3)
    place, ends = slow_best_fit(sizes, lengths, 3)
    assert list(zip(bins.tolist(), offsets.tolist())) == place and final.tolist() == ends


def test_joint_choice_is_never_dearer():
    rng = random.Random(1)
    for _ in range(20):
        sizes = np.array(sorted((int(rng.paretovariate(1)) % 800 + 1 for _ in range(300)), reverse=True))
        price = lambda found: sum(packing.cost(c) for c in found[2].tolist())
        joint = price(packing.pack_pieces(sizes, (64, 128, 512, 1024)))
        assert joint <= min(price(packing.best_fit(sizes, [c])) for c in (1024,))
        assert joint <= price(packing.best_fit(sizes, [64, 128, 512, 1024]))


def check(rows, sizes, lengths):
    """sizes: of all documents, by id, in lists."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        if r.length:
            bins[r.bin_id, r.capacity].append((r.offset, r.length))
        else:
            assert (r.bin_id, r.capacity, r.offset, r.piece) == (None, None, None, 0)
    longest = max(lengths)
    want = {
        i: sorted((a, min(longest, n - a)) for n in ns for a in (range(0, n, longest) if n else [0])) for i, ns in sizes.items()
    }
    assert {i: sorted(p) for i, p in pieces.items()} == want
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), held in bins.items():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert capacity == min(c for c in lengths if c >= at)
    return bins


@pytest.mark.parametrize("shard", [10, 50_000])
def test_pack(spark, documents, shard):
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([0, 1, 3, 20, 90, 400])) for i in range(200)]
    rows += [(7, "w " * 5)] * 40 + [(None, "w " * 3)] * 30 + [(500, None), (501, ""), (502, "x\n" * 5000)]
    docs = documents(rows, extra=["id", "size", "row", "piece", "length", "h", "shard", "bin_id"])
    sizes = defaultdict(list)
    for i, text in rows:
        sizes[i].append(len((text or "").split()))
    got = packing.pack(docs, lengths=(32, 64, 256), shard=shard).collect()
    bins = check(got, sizes, (32, 64, 256))
    filled = sum(sum(n for _, n in held) for held in bins.values()) / sum(c for _, c in bins)
    assert filled > (0.75 if shard == 10 else 0.97)


def test_empty(spark, documents):
    assert packing.pack(documents([])).collect() == []
    assert len(packing.pack(documents([(1, None), (1, None)])).collect()) == 2


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = defaultdict(list)
    for r in docs.collect():
        sizes[r.doc_id].append(len(r.text.encode().split()))
    bins = check(packing.pack(docs).collect(), sizes, packing.LENGTHS)
    assert sum(c for _, c in bins) < 1.02 * sum(sum(n) for n in sizes.values())
