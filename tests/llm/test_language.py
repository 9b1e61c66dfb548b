"""Languages: EM against a plain version, mixtures, held-out accuracy, odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from tripledger.llm import language

SF = "/root/testdata/sf0.01"


def slow_mixture(loglik):
    """One text: EM, then dropping the smallest language while the penalised likelihood holds."""
    n, k = loglik.shape
    like = np.exp(loglik - loglik.max(axis=1, keepdims=True))

    def settle(theta):
        for _ in range(60):
            joint = like * theta
            new = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
            moved, theta = np.abs(new - theta).max(), new
            if moved < 1e-3:
                break
        return theta, np.log((like * theta).sum(axis=1)).sum()

    theta, value = settle(np.full(k, 1 / k))
    while (theta > 0).sum() > 1:
        trial = theta.copy()
        trial[np.where(theta > 0, theta, np.inf).argmin()] = 0
        trial, score = settle(trial / trial.sum())
        if score + 0.5 * np.log(max(n, 2)) < value:
            break
        theta, value = trial, score
    return theta


def test_mixture():
    rng = np.random.default_rng(1)
    parts, texts = [], []
    for i in range(40):
        n = int(rng.integers(0, 60))
        truth = rng.dirichlet([0.3] * 4)
        loglik = rng.normal(-3, 1, (n, 4))
        loglik[np.arange(n), rng.choice(4, n, p=truth)] += 4
        parts.append(loglik)
        texts.append(np.full(n, i))
    got = language.mixture(np.concatenate(parts), np.concatenate(texts), 40)
    for row, loglik in zip(got, parts):
        np.testing.assert_allclose(row, slow_mixture(loglik) if len(loglik) else 0, atol=1e-9)


def test_letters():
    chars, text = language.letters(["Ab, c1d", "", "  ", "É\U0001f600x", "\U0010ffffq"])
    assert "".join(map(chr, chars)) == " ab c d é x q"
    assert text.tolist() == [0] * 7 + [3] * 4 + [4] * 2
    # n-grams do not see the word before
    one, two = language.letters(["xx ab"])[0], language.letters(["yy ab"])[0]
    assert (language.cells(one, 3, 17)[-2:] == language.cells(two, 3, 17)[-2:]).all()
    assert (language.cells(one, 3, 17)[1:3] != language.cells(two, 3, 17)[1:3]).all()


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify_documents(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "languages"]
    held = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (held.lang_pred == held.lang).mean() >= 0.98
    assert got.where("score is null or score < 0 or score > 1").count() == 0 and got.count() == docs.count()


def test_mixed_texts(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 1500 and 3000")
    one = {lang: docs.where(f"lang = '{lang}'").orderBy("doc_id").first().text for lang in ("en", "de")}
    text = one["de"] + " " + " ".join(one["en"].split()[:80])
    df = spark.createDataFrame([(text,)], "text string").select(language.predicted(F.col("text"), model).alias("p"))
    got = df.first().p
    assert got.lang == "de" and {"de", "en"} <= set(got.languages)
    assert sum(got.languages.values()) == pytest.approx(1)


def test_odd_rows(spark, documents):
    rows = [(i, "the cat sat on the mat", "en", None) for i in range(30)] + [(50 + i, "der hund und die katze", "de", None) for i in range(30)]
    odd = [(900, None), (901, ""), (902, "123 \U0001f600 --"), (None, "der hund"), (903, "the mat " * 60000), (903, "the mat " * 60000), (904, "Ω")]
    got = language.identify_documents(documents(rows + odd, extra=["p", "score", "size", "cell", "n"]))
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows + odd)
    assert [by[i].lang_pred for i in (900, 901, 902, None, 903)] == ["und", "und", "und", "de", "en"]
    assert by[900].score == 0 and by[904].lang_pred in ("en", "de")


def test_nothing_to_learn(spark, documents):
    assert as_set(language.identify_documents(documents([(1, "a")])).select("doc_id", "lang_pred", "score")) == [(1, "und", 0.0)]
    assert language.identify_documents(documents([])).collect() == []
