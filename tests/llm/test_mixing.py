"""Mixing: exact knapsack, targets by repeated sharing, the whole mix."""

import itertools
import random
import re
from collections import Counter

import pandas as pd
import pytest

from tests.conftest import as_set
from tripledger.llm import mixing


def test_knapsack():
    rng = random.Random(4)
    for _ in range(150):
        lengths = rng.sample(range(1, 25), rng.randint(0, 5))
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 60)
        best = max(
            (s for n in itertools.product(*[range(c + 1) for c in counts]) if (s := sum(a * b for a, b in zip(n, lengths))) <= budget),
            default=0,
        )
        taken = mixing.knapsack(lengths, counts, budget)
        assert sum(k * v for k, v in taken.items()) == best
        assert all(taken[k] <= counts[lengths.index(k)] for k in taken)


def test_fit_meets_any_budget():
    rng = random.Random(5)
    for _ in range(60):
        size = rng.sample(range(2, 400), 40) + [1]
        pdf = pd.DataFrame({"key": "k", "size": size, "n": [rng.randint(1, 50) for _ in size]})
        held = int((pdf["size"] * pdf["n"]).sum())
        budget = rng.randint(0, held)
        got = mixing._fit(pdf.assign(budget=budget)).merge(pdf, on="size")
        assert (got.extra <= got.n).all() and (got.extra >= 0).all()
        assert budget - 3 <= (got.extra * got["size"]).sum() <= budget, budget / held


def slow_targets(sizes, weights=(3, 1, 2), total=1.5, epochs=2):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, total * sum(sizes.values()), set(order)
    while free:
        rate = left / sum(weight[s] for s in free)
        above = {s for s in free if rate * weight[s] > epochs * sizes[s]}
        for s in above or free:
            target[s] = epochs * sizes[s] if above else rate * weight[s]
            left -= target[s]
        free -= above or free
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = [*rng.sample(["a", "B", "é", "z", "\U0001f600", "￿", "src1", "src10", "src2", ""], rng.randint(1, 9)), None]
    sizes = {n: rng.choice([0, 1, 5, 100, 10**6, 10**12]) for n in names}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(slow_targets(sizes), rel=1e-12)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def corpus():
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", rng.choice(["s1", "s1", "s1", "s2", None])) for i in range(300)]
    rows += [(1000 + i, "a b\tc\nd e", "en", "s2") for i in range(50)]  # ties
    rows += [(2000, "one two three", None, "s1")] * 20 + [(None, "x y", None, None)] * 5  # repeated rows
    return rows + [(3000, None, None, "s1"), (3001, "", None, "empty"), (3002, "w " * 3000, None, "s2")]


def test_mix(spark, documents):
    rows = corpus()
    docs = documents(rows, extra=["size", "target", "copies", "key", "i", "row"])
    got = mixing.mix(docs).collect()
    size = Counter()
    for _, text, _, source in rows:
        size[source] += words(text)
    target = slow_targets(dict(size))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, words(t)) for i, t, *_ in rows)
    source_of = {(i, words(t)): s for i, t, _, s in rows}
    taken = Counter()
    for r in got:
        source = source_of[(r.doc_id, r.size)]
        assert r.source_size == size[source] and r.target == pytest.approx(target[source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
    for s in size:
        assert target[s] - 2 < taken[s] <= target[s] + 1e-6
    again = mixing.mix(docs.repartition(7))
    assert as_set(again) == as_set(mixing.mix(docs))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    out = Counter()
    for r in mixed.collect():
        out[r.source] += words(r.text)
    assert out == +taken


def test_empty(spark, documents):
    assert mixing.mix(documents([])).collect() == []
    assert mixing.mixed_documents(documents([(1, None), (2, "")])).collect() == []
