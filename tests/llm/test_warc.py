import base64
import gzip
import hashlib
import io

import pytest

from waymark.llm import warc
from waymark.llm.queries import QUERIES


def plain(pages):
    least = {}
    for page, html in pages:
        p = (html or "").encode()
        if page is not None:
            least[p] = min(least.get(p, page), page)
    out = []
    for page, html in pages:
        p = (html or "").encode()
        first = least.get(p)
        again = first is not None and page != first
        out.append((page, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_whole_table(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert sorted((tuple(r) for r in QUERIES["op3_warc"](spark, sf).collect()), key=str) == plain(pages)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 50)
    rows = [(5, "u", "same"), (3, None, "same"), (3, "u", "same"), (None, "u", "same"), (7, "a\nb", None), (8, "", ""), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 30), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as first", "2 as n")
    assert sorted((tuple(r) for r in warc.archived(pages).collect()), key=str) == plain([(a, c) for a, _, c in rows])
    assert warc.archived(pages.where("page_id > 99")).collect() == []


def test_small_payloads_are_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id bigint, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w", least_bytes=3)).collect()
    assert sorted((r["page"], r["record_type"], r["refers_to"]) for r in got) == [("1", "response", None), ("2", "response", None), ("3", "response", None), ("4", "revisit", "3")]


def test_ids_that_look_like_none(spark):
    rows = [("null", "u", "same"), (None, "u", "same"), ("urn:page:x", "u", "same"), ("", "u", "other"), ("nopage", "u", "other"), ("ü/ <>", "u", "third")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    assert sorted((tuple(r) for r in warc.archived(pages).collect()), key=str) == plain([(a, c) for a, _, c in rows])


def member(payload=b"hello", **change):
    data = b"".join(warc.record(1, "http://x/", payload, warc.base32_sha1(payload), None, "2024-01-01T00:00:00Z"))
    plain = gzip.decompress(data)
    for old, new in change.values():
        plain = plain.replace(old, new)
    return plain


@pytest.mark.parametrize("size", [0, 3, warc.READ_BYTES, 1_000_003])
def test_records_are_gzip_members(size):
    data = bytes(i * 7 % 251 for i in range(size))
    blob = b"".join(b"".join(warc.record(i, "http://x/", data, warc.base32_sha1(data), None, "2024-01-01T00:00:00Z")) for i in range(3))
    got = list(warc.read_archive(io.BytesIO(blob)))
    assert [(g["page"], g["payload_bytes"], g["payload_digest"]) for g in got] == [(str(i), size, warc.base32_sha1(data)) for i in range(3)]


def test_broken_records_are_found():
    read = lambda plain: list(warc.read_archive(io.BytesIO(gzip.compress(plain))))
    good = member()
    assert len(read(good)) == 1
    for bad in (good.replace(b"hello", b"hallo"), good.replace(b"hello", b"hell"), good.replace(b"hello", b"hello!"), good[:-2], good[:40], b"x" + good):
        with pytest.raises(warc.Broken):
            read(bad)
    with pytest.raises(warc.Broken):
        list(warc.read_archive(io.BytesIO(gzip.compress(good)[:-12])))
