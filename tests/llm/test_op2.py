import base64
import gzip
import hashlib
import io
from collections import defaultdict

import pytest

from spindrift.llm import warc


def rows():
    html = ["<p>a</p>", "", None, "é" * 3000, "x" * 400000, "line\r\n\r\nbreak"]
    return [(k, f"http://h/{k}" if k % 5 else None, html[k % 6]) for k in range(40)] + [(None, "http://n/", "only"), (50, "a\r\nb", "q"), (3, "twice", html[3])]


@pytest.mark.parametrize("most", [warc.BROADCAST, 0])
def test_round_trip(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST", most)
    monkeypatch.setattr(warc, "HOT", 6)  # three digests fill a sixth of the rows or more
    data = rows()
    spark.createDataFrame(data, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    best = defaultdict(lambda: -1)
    for i, _, h in data:
        best[h or ""] = max(best[h or ""], -1 if i is None else i)
    want = []
    for i, _, h in data:
        p = (h or "").encode()
        top = best[h or ""]
        kind = "response" if top in (-1, i) else "revisit"
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), kind, top if kind == "revisit" else None))
    got = [tuple(r)[:5] for r in warc.op2_warc(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_pushdown_skips_payloads_and_splits(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k % 30}</p>" * 50) for k in range(60)], "page_id long, url string, html string")
    warc.register(spark)
    warc.deduplicated(pages).coalesce(1).write.format("warc").mode("append").option("split", "2000").save(path)
    df = warc.read_warc(spark, path)
    assert df.rdd.getNumPartitions() > 3
    assert df.filter("record_type = 'response'").count() == 30
    plan = df.filter("record_type = 'revisit' and target_uri like 'http://h/2%'")._jdf.queryExecution().toString()
    assert {r.target_uri for r in df.filter("record_type = 'revisit' and target_uri like 'http://h/2%'").collect()} == {f"http://h/{k}" for k in [2, *range(20, 30)]}
    assert "warc" in plan.lower()
    one = df.filter("target_uri = 'http://h/45'").first()
    assert bytes(one.payload).decode() == "<p>15</p>" * 50 and one.headers["warc-type"] == "response"
    assert warc.read_warc(spark, path, "false").filter("payload is not null").count() == 0


def test_foreign_archives(spark, tmp_path):
    rec = lambda n: (f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r{n}>\r\nContent-Length: {n}\r\n\r\n" + "z" * n + "\r\n\r\n").encode()
    (tmp_path / "a.warc").write_bytes(rec(5) + rec(20000) + rec(0))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(rec(7)) + gzip.compress(rec(300000)) + gzip.compress(rec(1)))
    (tmp_path / "c.warc").write_bytes(b"")
    for payload in ("true", "false"):
        got = warc.read_warc(spark, str(tmp_path), payload).collect()
        assert sorted(r.record_id for r in got) == sorted(f"r{n}" for n in (5, 20000, 0, 7, 300000, 1))
        if payload == "true":
            assert all(len(r.payload) == int(r.record_id[1:]) for r in got)


def test_a_second_write_keeps_the_first(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    for n in range(2):
        pages = spark.createDataFrame([(10 * n + k, None, f"page {n} {k}", "y", b"z") for k in range(5)], "page_id long, url string, html string, sha string, best binary")
        warc.write_warc(pages, path)
    got = warc.read_warc(spark, path).select("record_id", "payload").collect()
    assert sorted((int(r.record_id.split(":")[-1]), bytes(r.payload).decode()) for r in got) == [(10 * n + k, f"page {n} {k}") for n in range(2) for k in range(5)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op2_warc(spark, str(tmp_path)).count() == 0


def test_records_of_one_gzip_member():
    blocks = [b"x" * n for n in (5, 0, 300000, 70)] + [hashlib.sha256(b"%d" % k).hexdigest().encode() * 900 for k in range(4)]
    plain = b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    data = gzip.compress(plain) + gzip.compress(plain[: plain.index(b"WARC/1.0", 8)])
    for payload in (True, False):
        got = [(int(r.headers["content-length"]), r.payload) for r in warc.records(io.BytesIO(data), 0, None, lambda h: True, payload)]
        assert got == [(len(b), b if payload else None) for b in [*blocks, blocks[0]]]
