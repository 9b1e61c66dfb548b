"""WARC: exact round trips, plain and compressed, predicates that skip payloads, commits."""

import gzip
import hashlib
import io
import json
import random
from collections import defaultdict

import pytest

from tripledger.llm import warc
from tripledger.sources.workdir import fresh_dir


def expected(rows, least=1000):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least:
            groups[body].append(page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        ids = [i for i in groups.get(body, []) if i is not None]
        again = len(groups.get(body, [])) > 1 and ids and page_id != max(ids)
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", max(ids) if again else None))
    return sorted(out, key=repr)


def pages():
    rng = random.Random(1)
    bodies = ["", None, "x", "é" * 499, "é" * 500, "y" * 999, "z" * 1000, "WARC/1.1\r\n\r\n" * 200, "\r\n\r\n" * 300, "long \U0001f600 " * 20000]
    rows = [(i, f"http://h/{i}", rng.choice(bodies)) for i in range(120)]
    return rows + [(500, None, "q" * 2000), (500, "http://a\r\nX: y", "q" * 2000), (None, "u", "q" * 2000), (None, "u", "w" * 3000), (None, "u", "w" * 3000)]


SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, compression):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' payload", "'d' sha1", "1 n", "2 first").repartition(5)
    path = fresh_dir(spark, "warc")
    warc.write_pages(df, path, compression)
    assert sorted(map(tuple, warc.archived_pages(spark, path).collect()), key=repr) == expected(rows)
    # payloads come back byte by byte
    back = {r.record_id: r.payload for r in warc.read(spark, path, payload=True).where("record_type = 'response'").collect()}
    assert all(bytes(back[f"<{warc.RECORD}{i}>"]) == (t or "").encode() for i, _, t in rows if f"<{warc.RECORD}{i}>" in back and i != 500)
    assert warc.read(spark, path).where("payload is not null").count() == 0
    uris = {r.target_uri for r in warc.read(spark, path).where("payload_length = 2000 and record_type = 'response'").collect()}
    assert uris == {None, "http://a X: y"}


def test_pushdown(spark):
    path = fresh_dir(spark, "warc")
    warc.write_pages(spark.createDataFrame(pages(), SCHEMA), path)
    df = warc.read(spark, path, payload=True).where("record_type = 'revisit' and target_uri like 'http://h/1%' and length(record_id) > 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (length" in plan.replace("Filter ((", "Filter (") and "= revisit" not in plan
    want = [r for r in expected(pages()) if r[3] == "revisit" and str(r[0]).startswith("1")]
    assert df.count() == len(want) > 0


class Counting(io.BytesIO):
    got = 0

    def read(self, n=-1):
        data = super().read(n)
        self.got += len(data)
        return data


@pytest.mark.parametrize("zipped", [True, False])
def test_unwanted_payloads_are_skipped(zipped):
    rng = random.Random(2)
    rows = [dict(record_type="response" if i % 10 else "metadata", record_id=f"<r{i}>", target_uri="u", date="d", payload_digest="x", refers_to=None,
                 payload_length=None, payload=rng.randbytes(300_000)) for i in range(20)]
    data = b"".join(warc.gzip_member(warc.encode_record(r)) if zipped else warc.encode_record(r) for r in rows)
    file = Counting(data)
    got = list(warc.read_records(file, lambda h: h.column("record_type") == "metadata", True))
    assert [h.column("record_id") for h, _ in got] == ["<r0>", "<r10>"]
    assert [p for _, p in got] == [rows[0]["payload"], rows[10]["payload"]]
    assert file.got < 0.3 * len(data)
    heads = Counting(data)
    assert len(list(warc.read_records(heads, lambda h: True, False))) == 20 and heads.got < 0.2 * len(data)


def test_other_writers():
    """Archives without skip lengths, one member per record, and blocks that are not HTTP."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [dict(record_type="response", record_id=f"<{i}>", payload_length=None, payload=b"p" * i) for i in range(50)]
    records = [info, *map(warc.encode_record, rows)]
    for data in (b"".join(map(gzip.compress, records)), b"".join(records)):
        got = list(warc.read_records(io.BytesIO(data), lambda h: True, True))
        assert [p for _, p in got] == [b"hello", *(r["payload"] for r in rows)]
        assert gzip.decompress(data) == b"".join(records) if data[:2] == b"\x1f\x8b" else True
    assert gzip.decompress(b"".join(map(warc.gzip_member, records))) == b"".join(records)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"".join(records)[:-20]), lambda h: True, True))


def test_commit(spark, tmp_path):
    """Only what MANIFEST lists is read; without one all archives are."""
    path = f"file://{tmp_path}/w"
    warc.write_pages(spark.createDataFrame(pages(), SCHEMA).repartition(3), path, "none")
    names = json.loads((tmp_path / "w" / warc.MANIFEST).read_text())
    (tmp_path / "w" / "part-lost.warc").write_bytes((tmp_path / "w" / names[0][0]).read_bytes())
    assert warc.read(spark, path).count() == len(pages())
    (tmp_path / "w" / warc.MANIFEST).rename(tmp_path / "w" / "old")
    assert warc.read(spark, path).count() > len(pages())
    with pytest.raises(Exception, match="nowhere"):
        warc.read(spark, f"file://{tmp_path}/nowhere").collect()


def test_empty(spark):
    path = fresh_dir(spark, "warc")
    warc.write_pages(spark.createDataFrame([], SCHEMA), path)
    assert warc.archived_pages(spark, path).collect() == []
