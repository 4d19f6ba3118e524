from __future__ import annotations

import base64
import hashlib

import duckdb
import pytest

from girder.llm import queries, warc

from .conftest import SF


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/\r\nX: y", "same"), (3, None, "same"), (9, "http://b", None), (8, "", ""), (7, "u", "x" * 300_000), (None, "n", "same"), (None, "m", "lone"), (3, "again", "same"), (11, "ü", "ä\r\n\r\nWARC/1.1\x00")]
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, address int, payload string")


def test_round_trip(pages):
    rows = warc.read_records(warc.write_archive(pages)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.page_id, []).append(r)
    assert len(rows) == pages.count()
    for p in pages.collect():
        body = (p.html or "").encode()
        for r in by[p.page_id]:
            if p.page_id is not None:
                assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert [(r.record_type, r.refers_to) for r in by[5]] == [("revisit", 3)] and {r.record_type for r in by[3]} == {"response"}
    assert by[9][0].refers_to == 8 and by[8][0].record_type == "response"
    assert sorted((r.record_type, r.refers_to) for r in by[None]) == [("response", None), ("revisit", 3)]


def test_payloads_are_stored_once(pages):
    archive = warc.write_archive(pages)
    assert archive.payloads.count() == 5 == archive.payloads.select("address").distinct().count()
    assert warc.open_archive(pages.sparkSession, archive.headers_path, archive.payloads_path).headers.count() == pages.count()


def test_small_payloads_are_all_responses(pages):
    rows = warc.read_records(warc.write_archive(pages, min_bytes=5)).collect()
    assert {r.record_type for r in rows} == {"response"}


def test_records_parse_and_bad_ones_do_not(pages):
    for r in warc.records(warc.write_archive(pages)).collect():
        fields, block = warc.parse_record(bytes(r.record))
        assert fields["WARC-Type"] in ("response", "revisit") and "X" not in fields
        assert bytes(r.record).endswith(block + b"\r\n\r\n")
    for bad in (b"", b"WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n", b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_damage_is_noticed(spark, pages):
    a = warc.write_archive(pages)
    broken = a.payloads.selectExpr("address", "n", "sha1", "case when n = 4 then cast('evil' as binary) else payload end payload")
    with pytest.raises(Exception, match="doesn't match its digests"):
        warc.read_records(warc.Archive(a.headers, broken, "", "")).collect()


def test_a_wrong_digest_of_a_revisit_is_noticed(pages):
    a = warc.write_archive(pages)
    broken = a.payloads.selectExpr("address", "n", "reverse(sha1) sha1", "payload")
    with pytest.raises(ValueError, match="digest of a revisit"):
        warc.read_records(warc.Archive(a.headers, broken, "", ""))


def test_popular_payloads_are_not_joined_by_address(pages, monkeypatch):
    want = sorted(map(tuple, warc.read_records(warc.write_archive(pages)).collect()), key=repr)
    for hot in (1, 4, 1000):
        monkeypatch.setattr(warc, "HOT", hot)
        assert sorted(map(tuple, warc.read_records(warc.write_archive(pages)).collect()), key=repr) == want


def test_empty_table(pages):
    assert warc.read_records(warc.write_archive(pages.limit(0))).count() == 0


def test_against_sql(spark):
    got = {tuple(r) for r in queries.op3_warc(spark, SF).collect()}
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    want = set(con.sql(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({queries.oracle_sql()['op3_warc']})").fetchall())
    assert got == want
