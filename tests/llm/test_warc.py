"""ARC to WARC: parsing, round trips, revisits."""

import hashlib

import pytest

from lateline.llm import warc

LONG = "päge " * 400
PAGES = [
    (1, "http://a.example/x", LONG),
    (2, "http://a.example/y z", LONG),
    (7, "http://b.example/", LONG),
    (3, "http://b.example/s", "short"),
    (4, None, "short"),
    (5, "", None),
    (6, "http://c.example/", ""),
    (8, "http://c.example/", "\r\n\r\nWARC/1.1\r\n\r\n" * 100),
    (9, "http://c.example/", "filedesc://x 0 0 0 0\n" * 60),
    (10, "http://c.example/", LONG + "x"),
    (10, "http://c.example/", LONG + "x"),
    (None, "http://d.example/", LONG),
    (11, "http://e.example/", "y" * 300_000),
]


def plain(rows):
    largest = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if page_id is not None and len(body) >= 1000:
            largest[body] = max(page_id, largest.get(body, page_id))
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        refers = largest.get(body) if page_id is not None and largest.get(body) != page_id else None
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if refers is not None else "response", refers, True))
    return sorted(out, key=str)


def test_query(spark, tmp_path):
    rows = [(*page, "clash") for page in PAGES]
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(map(tuple, warc.query(spark, str(tmp_path)).collect()), key=str) == plain(PAGES)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.query(spark, str(tmp_path)).count() == 0


def test_many_files(spark, tmp_path):
    pages = spark.range(100).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(id % 7, 1200) as html")
    warc.write_arc(pages.coalesce(1), str(tmp_path / "arc"), file_records=8)
    assert len(list((tmp_path / "arc").rglob("part-*.gz"))) == 2 * -(-50 // 7)
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    rows = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert len(rows) == 100 and all(r["intact"] for r in rows)
    assert sum(r["record_type"] == "response" for r in rows) == 7
    assert {r["refers_to"] for r in rows} - {None} == set(range(93, 100))


def test_arc_versions_and_bytes(spark, tmp_path):
    body = b"HTTP/1.0 404 Not Found\r\n\r\n\xff\xfe\n\n"
    one = warc.version_block(1).encode() + b"\n" + b"http://x/ 1.2.3.4 1997 text/html %d\n" % len(body) + body + b"\n\n"
    one += b"dns:x 1.2.3.4 19970102030405 text/dns 3\nabc\n"
    two = warc.version_block(2).encode() + b"\nhttp://y/ 1.2.3.4 20010203040506 text/plain 200 - - 7 f.arc 2\nhi\n"
    records = list(warc.parse_arc(one)) + list(warc.parse_arc(two))
    assert [warc.warc_type(r) for r in records] == ["warcinfo", "response", "resource", "warcinfo", "resource"]
    assert records[1]["block"] == body and records[4]["status"] == "200"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc").write_bytes(one)
    (tmp_path / "arc" / "b.arc").write_bytes(two)
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    rows = {r["url"]: r for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert rows["http://x/"]["payload_digest"] == hashlib.sha1(b"\xff\xfe\n\n").hexdigest()
    assert all(r["intact"] for r in rows.values()) and rows["dns:x"]["record_type"] == "resource"


def test_a_damaged_payload_shows(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/1", "first page"), (2, "http://h/2", "second page")], "page_id long, url string, html string")
    warc.write_arc(pages, str(tmp_path / "arc"))
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    (tmp_path / "damaged").mkdir()
    for n, file in enumerate((tmp_path / "warc").rglob("part-*")):
        content = warc.unzipped(file.read_bytes())
        (tmp_path / "damaged" / f"{n}.warc").write_bytes(content.replace(b"second page", b"second pagf"))
    got = {r["page_id"]: (r["intact"], r["payload_digest"]) for r in warc.read_warc(spark, str(tmp_path / "damaged")).collect()}
    assert got == {1: (True, hashlib.sha1(b"first page").hexdigest()), 2: (False, hashlib.sha1(b"second pagf").hexdigest())}


@pytest.mark.parametrize("broken", [b"http://x/ 1.2.3.4 1997 text/html 99\nshort\n", b"http://x/ 1 2\n", b"no line end"])
def test_broken_archives_are_refused(broken):
    with pytest.raises(warc.BadArchive):
        list(warc.parse_arc(warc.version_block(1).encode() + b"\n" + broken))


def test_dates():
    assert warc.warc_date("20240115093000") == "2024-01-15T09:30:00Z"
    assert warc.warc_date("1997") == "1997-01-01T00:00:00Z"
