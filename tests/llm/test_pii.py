"""Pseudonyms: permutations, formats, round trips, links across documents."""

import random
import re

import pytest

from tests.conftest import as_set
from tripledger.llm import pii

KEY = b"test key"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_one_cycle(size):
    cycle = pii.Permutation(KEY, "t", size)
    assert sorted(cycle.forward(i) for i in range(size)) == list(range(size))
    assert all(cycle.backward(cycle.forward(i)) == i for i in range(size))
    turned = [cycle.turn(i) for i in range(size)]
    assert sorted(turned) == list(range(size))
    assert size == 1 or all(t != i for i, t in enumerate(turned))
    assert all(cycle.turn(t, -1) == i for i, t in enumerate(turned))


VALUES = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"],
    "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (017) 555-7713", "+442071838750", "+49-30-1234-5678"],
    "ip": ["10.0.0.1", "233.254.104.120", "1.43.173.185"],
    "date": ["2024-02-29", "31.12.1999", "02/28/1850", "0001-01-01", "9999-12-31"],
    "mail": ["enpa.68@mail7.example.com", "A_b+9@x.org", "q@y.de"],
}
LEFT = ["4111111111111112", "9807915762804490", "DE89370400440532013001", "666-12-3456", "256.1.1.1", "1.2.3.4.5",
        "2023-02-29", "31.04.2024", "version 3.", "CC BY-NC 4.0.", "a@b", "@x.org", "0000-01-01", "01.2.3.4"]


@pytest.mark.parametrize("kind", VALUES)
def test_values(kind):
    for value in VALUES[kind]:
        new, found = pii.pseudonymise(f"see {value}, or {value}!", KEY)
        assert [f["kind"] for f in found] == [kind] * 2, value
        assert value not in new
        one, two = re.fullmatch(r"see (.*), or (.*)!", new).groups()
        assert one == two  # equal values stay linked
        if kind != "ip":
            assert re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", one))) == re.sub(
                "[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", value))
            )
        again, found = pii.pseudonymise(new, KEY)
        assert [f["kind"] for f in found] == [kind] * 2  # still valid
        assert pii.pseudonymise(new, KEY, -1)[0] == f"see {value}, or {value}!"
        assert pii.pseudonymise(value, b"other")[0] != one
    start, end = found[0]["start"], found[0]["end"]
    assert new[start:end] == one


def test_left_alone():
    for value in LEFT:
        assert pii.pseudonymise(f"see {value} now", KEY) == (f"see {value} now", [])


def test_same_value_other_notation():
    iso, dotted, us = (pii.pseudonymise(v, KEY)[0] for v in ("2024-03-05", "05.03.2024", "03/05/2024"))
    assert iso == f"{dotted[6:]}-{dotted[3:5]}-{dotted[:2]}" == f"{us[6:]}-{us[:2]}-{us[3:5]}"
    plain, spaced = (pii.pseudonymise(v, KEY)[0] for v in ("4111111111111111", "4111 1111 1111 1111"))
    assert plain == spaced.replace(" ", "")


def test_neighbours():
    for text, kinds in {
        "+1 (017) 555-7713 235.58.234.215": ["phone", "ip"],
        "7536784127813050 4111111111111111": ["card"],
        "4111111111111111 123": ["card"],
        "4111111111111111 378282246310005": ["card", "card"],
        "DE89 3704 0044 0532 0130 00 THEN": ["iban"],
        "a.1@x.example.com 10.1.2.3": ["mail", "ip"],
        "10.0.0.1@x.org": ["mail"],
    }.items():
        new, found = pii.pseudonymise(text, KEY)
        assert [f["kind"] for f in found] == kinds, text
        assert pii.pseudonymise(new, KEY, -1)[0] == text


def test_behind_numbers():
    """Values that stand behind another number are found, whatever number it is."""
    for text, values in {
        "48213 2024-01-05": ["2024-01-05"],
        "10023 123-45-6789": ["123-45-6789"],
        "12 2024-01-05 2024-01-06": ["2024-01-05", "2024-01-06"],
        "2024 4111 1111 1111 1111": ["4111 1111 1111 1111"],
        "10115 4111 1111 1111 1111": ["4111 1111 1111 1111"],
        "2024-4111 1111 1111 1111": ["4111 1111 1111 1111"],
        "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 5500-0000-0000-0004 16 17": ["5500-0000-0000-0004"],
        "4111111111111111 2024-01-05 123-45-6789 378282246310005": ["4111111111111111", "2024-01-05", "123-45-6789", "378282246310005"],
        "7821 3000 1234 12/31/1999": ["12/31/1999"],
        "7821 3000 12345 10.0.0.1": ["10.0.0.1"],
        "AB12 4111 1111 1111 1111": ["4111 1111 1111 1111"],
        "AB12 4111111111111111": ["4111111111111111"],
        "AB12 DE89 3704 0044 0532 0130 00": ["DE89 3704 0044 0532 0130 00"],
        "AB12 3456 7890 1234 2024-01-05": ["2024-01-05"],
    }.items():
        new, found = pii.pseudonymise(text, KEY)
        assert [text[f["start"] : f["end"]] for f in found] == values, text
        assert not any(value in new for value in values)
        assert pii.pseudonymise(new, KEY, -1)[0] == text


def test_phone_notations():
    for value in ["+44 7911 123456", "+49 30 1234567", "+33 1 23 45 67 89", "+1 650-253-0000", "+49 30 123456-78", "+49 (30) 1234567",
                  "+44 (0)20 7183 8750", "+33.1.23.45.67.89", "+4420 7183 8750", "+33 12 34 56 78 90", "+1 (017) 555-7713", "+49-30-1234-5678"]:
        for text in (value, f"call {value}, or", f"{value} 2024-01-05", f"{value} 4111111111111111", f"{value} 3rd"):
            new, found = pii.pseudonymise(text, KEY)
            phone = next(f for f in found if f["kind"] == "phone")
            assert text[phone["start"] : phone["end"]] == value, text
            assert len(found) == 1 + ("2024" in text) + ("4111" in text)
            assert pii.pseudonymise(new, KEY, -1)[0] == text
    for text in ("+3.14159265", "+12 345", "+1 2 3 4", "a+44 7911 123456x", "+44 7911 123456x"):
        assert pii.pseudonymise(text, KEY) == (text, [])


def test_numbers_before_dates():
    """A number and a date are never read as a card, however their digits turn out."""
    for i in range(2000):
        text = f"{40000 + i} 2024-01-{i % 28 + 1:02d}"
        new, found = pii.pseudonymise(text, KEY)
        assert [f["kind"] for f in found] == ["date"] and new[:6] == text[:6]
        assert pii.pseudonymise(new, KEY, -1)[0] == text


def test_different_values_stay_different():
    rng = random.Random(2)
    cards = {pii._with_check_digit("4" + "".join(rng.choice("0123456789") for _ in range(14))) for _ in range(300)}
    assert len({pii.pseudonymise(c, KEY)[0] for c in cards}) == len(cards)


def test_documents(spark, documents):
    rows = [(1, "mail a.b@x.example.com"), (2, "also a.b@x.example.com 4111111111111111"), (3, None), (4, ""), (5, "plain"),
            (5, "plain"), (None, "10.0.0.1"), (6, "x " * 100000 + "10.0.0.1")]
    docs = documents(rows, extra=["found", "p", "raw", "kind"])
    want = {i: pii.pseudonymise(t, KEY)[0] if t is not None else None for i, t in rows}
    got = pii.pseudonymise_documents(docs, KEY)
    assert as_set(got.select("doc_id", "text", "n_found")) == sorted(
        [(i, want[i], len(pii.pseudonymise(t or "", KEY)[1])) for i, t in rows], key=repr
    )
    whole = pii.replace_in_documents(docs, KEY)
    assert whole.columns == docs.columns and whole.schema == docs.schema
    assert as_set(whole.select("doc_id", "text", "n_chars")) == sorted(
        [(i, want[i], None if t is None else len(want[i])) for i, t in rows], key=repr
    )
    assert pii.pseudonymise_documents(documents([]), KEY).collect() == []


def test_whole_table(spark):
    """Every row of the table against the function on its text."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in pii.pseudonymise_documents(docs, KEY).collect()}
    found = 0
    for doc in docs.collect():
        new, spans = pii.pseudonymise(doc.text, KEY)
        assert got[doc.doc_id].text == new and got[doc.doc_id].n_found == len(spans)
        for span in spans:
            assert doc.text[span["start"] : span["end"]] not in new
        found += len(spans)
    assert found > 50
