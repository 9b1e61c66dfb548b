"""Fingerprints against a plain version; what they promise as sums."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tripledger.llm import fingerprints as fp

SF = "/root/testdata/sf0.001"


def edits(rows):
    """Per row (id, number of characters, edited text, next text), by plain Python."""
    hashed = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (key, text) in enumerate(hashed):
        own, after = text or "", hashed[(i + 1) % len(hashed)][1] or ""
        half = len(own) // 2
        out.append((key, len(own), own[: len(own) - half] + after[:half], after))
    return out


def blocks(text):
    found = {}
    for line in (text or "").split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*", line)
        for i in range(0, len(words), 3):
            b = "".join(words[i : i + 3]).rstrip(" ")
            found[b] = found.get(b, 0) + 1
    return found


def shared(a, b):
    """The exact likeness that the lanes estimate."""
    a, b = blocks(a), blocks(b)
    norm = sum(n * n for n in a.values()) + sum(n * n for n in b.values())
    return 2 * sum(n * b.get(x, 0) for x, n in a.items()) / norm if norm else 1.0


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in fp.edit_and_compare(docs).collect()}
    texts = dict(rows)
    assert len(got) == len(rows)
    error = []
    for key, size, edited, after in edits(rows):
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (size, hashlib.sha256(edited.encode()).hexdigest())
        error += [r.near_edited - shared(texts[key], edited), r.near_next - shared(texts[key], after)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert (sum(e * e for e in error) / len(error)) ** 0.5 < 0.1
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.95 * len(got)
    by_text = {}
    for key, text in rows:
        assert by_text.setdefault(text, got[key].fingerprint) == got[key].fingerprint
    assert len(set(by_text.values())) == len({tuple(sorted(x for x in (t or "").split("\n") if x.strip())) for t in by_text})


def test_groups(spark, documents, monkeypatch):
    """Neighbours across the ends of groups, with gaps, and the last before the first."""
    monkeypatch.setattr(fp, "GROUP", 3)
    rng = random.Random(3)
    rows = [(i * i * (-1) ** i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 40)))) for i in range(150)]
    got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in fp.edit_and_compare(documents(rows)).collect()}
    assert got == {k: (n, hashlib.sha256(e.encode()).hexdigest()) for k, n, e, _ in edits(rows)}


def test_odd_rows(spark, documents):
    long = "\n".join(f"line {i} of a text" for i in range(20000))
    rows = [(3, None), (2, ""), (1, " \n\t\n"), (7, "x"), (8, long), (9, "é" * 7), (None, "last one")]
    docs = documents(rows, extra=["id", "group", "n", "guest", "t", "own", "head"])
    got = {r.doc_id: r for r in fp.edit_and_compare(docs).collect()}
    for key, size, edited, _ in edits(rows):
        assert (got[key].n_chars, got[key].edited_sha256) == (size, hashlib.sha256(edited.encode()).hexdigest())
    assert got[1].fingerprint == got[2].fingerprint == got[3].fingerprint and got[3].near_next == 1
    twice = documents([(1, "a b c"), (1, "a b c"), (1, "d e f\ng"), (None, "a"), (None, "b")])
    again = fp.edit_and_compare(twice).collect()
    assert len(again) == 5 and len({r.fingerprint for r in again if r.n_chars == 5}) == 1
    assert fp.edit_and_compare(documents([])).collect() == []
    alone = fp.edit_and_compare(documents([(5, "abcd")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1


def test_sums(spark, documents):
    """Order does not matter, and paragraphs go in and out by their own fingerprints."""
    lines = [f"line {i} has its words {i * 7}" for i in range(30)] + ["line 3 has its words 21"] * 2
    mixed = random.Random(1).sample(lines, len(lines))
    docs = documents([(1, "\n".join(lines)), (2, "\n\n".join(mixed)), (3, "\n".join(lines[5:] + ["new one"])), (4, "\n".join(lines[1:]))])
    prints = fp.fingerprints(docs, ["doc_id"], F.col("text"))
    texts = {r.doc_id: r.f for r in prints.select("doc_id", fp.as_text().alias("f")).collect()}
    assert texts[1] == texts[2] and len(set(texts.values())) == 3
    changes = documents([(i, x) for i, x in enumerate(lines[:5])] + [(99, "new one")])
    changes = fp.fingerprints(changes, ["doc_id"], F.col("text")).withColumn("sign", F.when(F.col("doc_id") == 99, 1).otherwise(-1))
    changed = prints.where("doc_id = 1").withColumn("sign", F.lit(1)).unionByName(changes).withColumn("doc_id", F.lit(3))
    assert fp.merge(changed, ["doc_id"], "sign").select(fp.as_text().alias("f")).first().f == texts[3]


@pytest.mark.parametrize("text", ["", " ", "a", "a b c d\n\n\te f", "x\r\ny  z\x0bq\n"])
def test_lanes(spark, documents, text):
    """Lanes are the bits of the blocks' two hashes."""
    row = fp.fingerprints(documents([(1, text)]), ["doc_id"], F.col("text")).first()
    assert row.blocks == sum(blocks(text).values())
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    assert [row[n] for n in fp.DIGEST] == [sum(int(d[8 * i : 8 * i + 8], 16) for d in digests) % 2**32 for i in range(8)]
