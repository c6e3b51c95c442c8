import hashlib

import duckdb
import pytest

from trigrove.llm import warc

SF = "/root/testdata/sf0.001"


def expected(rows):
    best = {}
    for i, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and i is not None:
            best[data] = max(best.get(data, i), i)
    out = []
    for i, h in rows:
        data = (h or "").encode()
        r = best.get(data)
        refers = r if i is not None and r is not None and r != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(map(str, out))


def test_awkward_pages(spark):
    big = "é" * 700
    pages = [(1, big), (2, big), (9, big), (9, big), (3, None), (4, ""), (5, "small"), (6, "small"), (7, "a\r\n\r\nWARC/1.1\r\n" * 100), (None, big), (8, "x" * 999), (10, "x" * 999), (11, "y" * 200_000), (-4, "z\0" * 800)]
    rows = [(i, "http://a b\r\n/" if i != 3 else None, h, "extra", 1) for i, h in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, body string, _digest int")
    got = warc.round_trip(df)
    assert sorted(str(tuple(r)) for r in got.collect()) == expected(pages)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_hold_the_payloads(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://h/{k}", "same " * 300 if k < 3 else f"own {k}") for k in range(5)], "page_id long, url string, html string")
    warc.write_archives(df, (tmp_path / "a").as_uri(), file_bytes=1)
    records = {r["record_id"]: r for r in warc.read_archives(spark, (tmp_path / "a").as_uri()).collect()}
    assert bytes(records["<urn:page:2>"]["payload"]) == b"same " * 300
    assert records["<urn:page:0>"]["payload"] is None and records["<urn:page:0>"]["refers_to_id"] == "<urn:page:2>"
    assert bytes(records["<urn:page:4>"]["payload"]) == b"own 4" and records["<urn:page:4>"]["url"] == "http://h/4"
    with pytest.raises(ValueError):
        list(warc.parse(b"no archive"))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in warc.query(spark, SF).collect())
