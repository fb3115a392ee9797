from __future__ import annotations

import base64
import hashlib
import os

from foldframe.llm import warc
from foldframe.llm.queries import ORACLE_SQL, QUERIES


def test_sql(agree):
    agree(QUERIES["op9_warc"], ORACLE_SQL["op9_warc"])


def _digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 600)
    long = "<p>ünï" * 20_000
    pages = [(5, "http://a/é b\n", "<p>x"), (2, None, "<p>x"), (9, "u", None), (7, "u", ""), (None, "u", "<p>x"), (3, "u", long), (3, "u", long), (None, "u", "alone"), (8, "u", "\r\n\r\n")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id bigint, url string, html string, refers_to string")
    out = str(tmp_path / "a")
    made = warc.write(df, out)
    rows = warc.read(made, out).collect()
    got = sorted([(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=str)

    def want(page, text, kind, first):
        return page and str(page), len((text or "").encode()), _digest(text), kind, first

    kinds = [("revisit", "2"), ("response", None), ("revisit", "7"), ("response", None), ("revisit", "2"), ("response", None), ("response", None), ("response", None), ("response", None)]
    assert got == sorted([want(p, t, *k) for (p, _, t), k in zip(pages, kinds, strict=True)], key=str)
    assert {r.url for r in rows if r.page == "5"} == {"http://a/%C3%A9%20b%0A"}
    # Below the least size nothing is a revisit.
    kinds = {r.page: r.record_type for r in warc.read(warc.write(df, out, least_bytes=1), out).collect()}
    assert kinds["9"] == "response" and kinds["5"] == "revisit"
    assert warc.write(df.limit(0), out).count() == 0
    # Each record is a frame of its own behind the dictionary.
    name = made.first().archive
    data = open(os.path.join(out, name), "rb").read()
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert sum(1 for _ in warc.read_records(data)) == made.filter(made.archive == name).first().records


def test_trained_dictionary(spark, tmp_path):
    df = spark.range(800).selectExpr("id AS page_id", "'http://x/' || id AS url", "'<html><body class=\"page\"><h1>' || id || '</h1>' || repeat('<p>' || md5(cast(id AS string)), 9) AS html")
    out = str(tmp_path / "b")
    assert warc.read(warc.write(df, out), out).selectExpr("sum(payload_bytes)", "count(distinct payload_digest)").first() == df.selectExpr("sum(length(html))", "count(*)").first()


def test_ids_that_need_escapes(spark, tmp_path):
    ids = ["a>b\nc", "", None, "é %41", "<x>", "plain"]
    df = spark.createDataFrame([(x, "u", f"<p>{i % 3}") for i, x in enumerate(ids)], "page_id string, url string, html string")
    out = str(tmp_path / "c")
    rows = warc.read(warc.write(df, out), out).collect()
    assert sorted(map(str, (r.page for r in rows))) == sorted(map(str, ids))
    assert {(r.page, r.refers_to) for r in rows if r.record_type == "revisit"} == {("é %41", "a>b\nc"), ("<x>", ""), (None, "plain")}
