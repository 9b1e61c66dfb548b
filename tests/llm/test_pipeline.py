"""The pipeline, stage by stage, against plain versions of what each stage decides."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_mixing import slow_targets, words
from tests.llm.test_packing import check
from tests.llm.test_simhash import expected
from tripledger.llm import packing, pii, queries, toxicity
from tripledger.sources.workdir import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "pii", "mixing", "packing"]
    start = spark.read.parquet(f"{SF}/documents.parquet")
    docs, results = start, {}
    for name, stage in stages.items():
        docs = materialize(stage(spark, docs, SF), name)
        results[name] = docs
        if name != "packing":
            assert docs.schema == start.schema

    scores = toxicity.score_documents(start, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id: r.text for r in start.join(scores.where("predicted = 0"), "doc_id", "left_semi").collect()}
    assert {r.doc_id: r.text for r in results["toxicity"].collect()} == clean

    classes = expected(sorted(clean.items()))
    first = {i: clean[i] for i, _, component in classes if i == component}
    assert {r.doc_id: r.text for r in results["simhash"].collect()} == first

    hidden = {i: pii.pseudonymise(t, queries.DEMO_KEY)[0] for i, t in first.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in results["pii"].collect()} == {i: (t, len(t)) for i, t in hidden.items()}

    size, taken, copies = Counter(), Counter(), Counter()
    for r in results["pii"].collect():
        size[r.source] += words(r.text)
    for r in results["mixing"].collect():
        assert r.text == hidden[r.doc_id]
        taken[r.source] += words(r.text)
        copies[r.doc_id] += 1
    longest = max(words(t) for t in hidden.values())
    assert max(copies.values()) <= 2
    for source, target in slow_targets(dict(size)).items():
        assert target - longest < taken[source] <= target + 1e-6

    sizes = defaultdict(list)
    for r in results["mixing"].collect():
        sizes[r.doc_id].append(words(r.text))
    check(results["packing"].collect(), sizes, packing.LENGTHS)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "bin_id", "capacity", "offset"]
    assert rows.count() > 0 and rows.where("bin_id is null").count() == 0


def test_odd_rows(spark, documents):
    """Nulls, empty and very long texts, repeated rows and ties, and no rows at all, through every
    stage: what is clean and not alike stays, and the columns of documents stay documents' own."""
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b c"), (4, "a b c"), (None, "d e f g h"), (5, long), (6, long), (7, "é" * 50, None, "s")]
    rows = [(i if i is None else i - 100, *rest) for i, *rest in rows]  # ids that no label has
    rows += [(-50 + i, " ".join(f"x{i}y{j}" for j in range(30)), "en", f"s{i % 3}") for i in range(12)]
    for docs in (documents(rows), documents([])):
        count = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), name)
            if name != "packing":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            if name == "toxicity":
                assert docs.count() == count
            if name == "simhash" and count:
                kept = [r.doc_id for r in docs.select("doc_id").collect()]
                assert -95 in kept and -94 not in kept and set(range(-50, -38)) <= set(kept)
            if name == "pii" and count:
                assert long in {r.text for r in docs.collect()}
        assert (docs.count() > 0) == (count > 0)
