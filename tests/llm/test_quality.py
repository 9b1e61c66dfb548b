"""Quality rules: counts by plain Python, the binomial bound by fractions, the guarantee."""

import random
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from tripledger.llm import quality

GAPS = " \t\n\x0b\x0c\r"


def slow_words(text):
    for c in GAPS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def slow_counts(text):
    text = text or ""
    words = slow_words(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if slow_words(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a a a a"), (6, "a b c a b c"), (7, "x\nx \nx\n\n\nx"), (8, "\x0ba\x0cb\rc d  "),
            (9, "\U0001f600 é   # <>"), (10, "\n".join(["l1 ##", "l2", "l1 ##"])), (None, "a b a b a b")]
    for i in range(200):
        n = rng.choice([3, 10, 60, 400])
        words = [rng.choice("abcdefgh") + rng.choice(["", "é", "#", "!"]) for _ in range(n)]
        rows.append((100 + i, "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words)))
    rows.append((900, " ".join(str(rng.randrange(40)) for _ in range(9000))))  # over SHORT
    rows.append((901, " ".join(str(i) for i in range(9000)) + " 5 6 7"))
    return rows + [rows[20], rows[20]]


def test_counts(spark, documents):
    rows = corpus()
    docs = documents(rows, extra=["id", "stratum", "n_words", "parts", "n_lines"])
    got = quality.measures(docs).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert as_set(got) == sorted([(i, *slow_counts(t)) for i, t in rows], key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.measures(docs).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert as_set(got) == sorted([(r.doc_id, *slow_counts(r.text)) for r in docs.collect()], key=repr)


def test_binomial(spark):
    rate = 0.0125
    cases = [(0, 1), (0, 100), (0, 3000), (2, 500), (30, 4000), (49, 4000), (50, 4000), (19, 2000), (24, 2000), (1100, 100000)]
    df = spark.createDataFrame(cases, "k long, n long")
    p = Fraction(rate)
    for r in df.withColumn("p", quality.binomial_at_most(F.col("k"), F.col("n"), rate)).collect():
        if r.k >= r.n * rate:
            assert r.p == 1
        elif r.n <= 4000:
            exact = sum(comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
            assert r.p == pytest.approx(float(exact), rel=1e-9)
        else:
            assert 0 < r.p < 1e-4


def test_cutoffs(spark):
    """Cutoffs by plain counting, and none where the labels cannot carry one."""
    rng = random.Random(2)
    rows = [(i, rng.choice(["en", "en", "de"]), 100, 1000, rng.choice([0, 0, 0, 5, 20, 300]) if rng.random() < 0.02 else 0) for i in range(6000)]
    rows += [(10_000 + i, "fr", 100, 1000, 0) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, stratum string, n_words long, word_chars long, n_symbols long")
    df = df.selectExpr("*", "0L n_lines", "0L n_dup_lines", "0L n_repeat_words", "0L n_exclaims", "0L n_capitals")
    labels = spark.createDataFrame([(i, 1) for i, *_ in rows] + [(0, 0), (1, None), (None, 1)], "doc_id long, quality int")
    got = {(r.stratum, r.rule): (r.cutoff, r.n, r.k) for r in quality.cutoffs(df, labels).collect()}
    assert not any(s == "fr" for s, _ in got)
    rate, level = Fraction(0.05) / 5, 0.05 / 15
    for stratum in ("en", "de"):
        held = [r for r in rows if r[1] == stratum and r[0] != 0]
        want = None
        for c in range(50, 0, -1):
            k = sum(r[4] * 50 > c * r[3] for r in held)
            chance = sum(comb(len(held), i) * rate**i * (1 - rate) ** (len(held) - i) for i in range(k + 1))
            if k >= len(held) * rate or chance > level:
                break
            want = (c, len(held), k)
        assert got[stratum, "symbols"] == want


def test_judge(spark, documents):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(80)), "en", None) for i in range(1500)]
    rows += [(2000 + i, " ".join(word() + "#*" for _ in range(80)), "en", None) for i in range(20)]
    rows += [(3000, None, None, None), (3001, "short", "en", None), (3002, "a b c " * 50, "en", None)]
    docs = documents(rows, extra=["id", "stratum", "kept", "limit_symbols"])
    labels = spark.createDataFrame([(i, 1) for i in range(1500)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(1500)) and not any(got[i].kept for i in range(2000, 2020))
    assert got[2000].rejected_by == "symbols" and not got[2000].base_failed
    assert got[3000].base_failed and got[3001].base_failed and got[3002].base_failed and not got[3002].kept


def test_empty(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(documents([]), labels).collect() == []
    assert [r.kept for r in quality.judge(documents([(1, "w " * 60 + "x y z")]), labels).collect()] == [False]
