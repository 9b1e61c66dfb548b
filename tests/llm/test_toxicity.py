"""The toxicity field: exact marginals, held-out accuracy, odd inputs."""

import itertools

import numpy as np
import pandas as pd
import pytest

from tests.conftest import as_set
from tripledger.llm import crf, toxicity

SF = "/root/testdata/sf0.1"


def slow_marginals(emission, step):
    """By enumerating all label sequences after a background token."""
    total, ones = 0.0, np.zeros(len(emission))
    for labels in itertools.product((0, 1), repeat=len(emission)):
        weight, before = 1.0, 0
        for e, y in zip(emission, labels):
            weight *= step[before, y] * (np.exp(e) if y else 1)
            before = y
        total += weight
        ones += weight * np.array(labels)
    return ones / total


@pytest.mark.parametrize("chunk", [1, 2, 3, 256])
def test_marginals(monkeypatch, chunk):
    monkeypatch.setattr(crf, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    lengths = np.array([0, 5, 1, 9, 0, 3, 8])
    emission = rng.normal(0, 2, lengths.sum())
    step = np.exp(rng.normal(0, 1, (2, 2)))
    p, _, _ = crf.marginals(emission, step, crf.layout(lengths))
    at = 0
    for n in lengths:
        np.testing.assert_allclose(p[at : at + n], slow_marginals(emission[at : at + n], step), atol=1e-12)
        at += n


def test_fit_learns_context():
    """The word 3 is an offence only after the word 2."""
    rng = np.random.default_rng(0)
    lengths = rng.integers(5, 60, 300)
    ids = rng.choice([0, 0, 0, 2, 3], lengths.sum())
    left, _ = crf.neighbours(ids, lengths)
    labels = ((ids == 3) & (left == 2)).astype(np.int64)
    model = crf.fit({"a": 2, "b": 3}, ids, labels, lengths, rounds=80, l2=0.1)
    assert ((model.tag(ids, lengths) > 0.5) == labels).mean() > 0.999


@pytest.mark.parametrize("copies", [1, 500])
def test_copies(copies):
    """However often one toxic text is copied, the offence in it and in others is learned."""
    text = lambda name, n=20: " ".join(f"{name}{j}" for j in range(n))
    copied = text("c") + " foo " + text("d")
    toxic = [copied] * copies + [f"{text(f'a{i}x')} foo {text(f'b{i}x')}" for i in range(40)]
    toxic += [f"{text(f'e{i}x')} bar {text(f'f{i}x')}" for i in range(400)]
    clean = [text(f"w{i}x") for i in range(900)] + [copied.replace("foo", "so")] * copies
    rows = [(1, t) for t in toxic] + [(0, t) for t in clean]
    frame = pd.DataFrame([(y, i, 0, t) for i, (y, t) in enumerate(rows)], columns=["toxic", "key", "part", "passage"])
    words = [t.split() for _, t in rows]
    assert toxicity.offences(words, frame["toxic"].to_numpy()) == {"foo", "bar"}
    scores, spans = toxicity.train(frame, 0.5).batch([copied, "quite new foo here", "quite new bar here", copied.replace("foo", "so")])
    assert [len(s) for s in spans] == [1, 1, 1, 0] and min(scores[:3]) > 0.5 > scores[3]


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels)
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    assert (held.predicted == held.toxic).mean() >= 0.97
    clean, toxic = held.score[held.toxic == 0].to_numpy(), held.score[held.toxic == 1].to_numpy()
    assert (toxic[:, None] > clean[None, :]).mean() >= 0.9
    assert not got.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count()
    # the spans lie on whole tokens of the text
    spans = got.join(docs, "doc_id").selectExpr("explode(spans) s", "text").selectExpr("substring(text, s.start + 1, s.end - s.start) w")
    assert spans.where("w <> trim(w) or w = ''").count() == 0 and spans.count() > 0


def test_odd_rows(spark, documents):
    rows = [(i, "you utter foo " + " ".join(f"w{i}{j}" for j in range(20))) for i in range(60)]
    rows += [(100 + i, " ".join(f"w{i}{j}" for j in range(20))) for i in range(60)]
    odd = [(900, None), (901, ""), (902, " \n "), (None, "w1 foo"), (903, "foo " * 50000), (903, "foo " * 50000)]
    docs = documents(rows + odd, extra=["score", "t", "key", "toxic"])
    pairs = [(i, 1 if i < 100 else 0) for i, _ in rows] + [(None, 1), (5, None)]
    labels = spark.createDataFrame(pairs, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert got[903].predicted == 1 and got[900].predicted == got[901].predicted == got[902].predicted == 0
    assert got[900].spans == [] and got[903].spans[0].start == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_no_labels(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert as_set(toxicity.score_documents(docs, labels).select("doc_id", "score", "predicted")) == [(1, 0.0, 0), (2, 0.0, 0)]
    assert toxicity.score_documents(documents([]), labels).collect() == []
    assert toxicity.drop_toxic(docs, labels).count() == 2
