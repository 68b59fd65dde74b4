"""WARC archives: round trip, revisits, and the merged index."""

import gzip
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from marginalia.llm import warc

SCHEMA = "doc_id long, file_name string, markdown string, written_at timestamp"


def at(second):
    return datetime.fromtimestamp(second, UTC)


def archived(spark, tmp_path, rows, clash=False):
    table = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for name in ("identity", "kept", "bytes", "own", "date", "value"):
            table = table.withColumn(name, F.lit(3))
    folder = str(tmp_path / "archives")
    warc.write_archives(table, folder)
    return warc.merge_captures(warc.read_archives(spark, folder)), folder


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    monkeypatch.setattr(warc, "ROWS_PER_RANGE", 40)
    pick = random.Random(8)
    bodies = ["", "a", "é\r\n\r\nWARC/1.1\r\n", "x" * 5000, "line\n\n\r\n\r\n", "\r\n"] + [f"text {i}" for i in range(40)]
    rows = [(i, f"https://www.h{pick.randrange(3)}.example/p{pick.randrange(30)}?b=2&a=1#f", pick.choice(bodies), at(pick.randrange(50)))
            for i in range(200)]
    rows += [(300, None, None, None), (301, "x y\r\nWARC-Type: z%20", "a", at(0)), (302, "http://[bad", "a", at(1))]
    found, folder = archived(spark, tmp_path, rows, clash=True)
    got = sorted(found.collect(), key=lambda r: r.position)
    assert len(got) == len(rows) == len({r.position for r in got})
    kept = {}
    for doc, _, body, _ in rows:
        kept[body or ""] = max(kept.get(body or "", -1), doc)
    expected = {doc: (name, len((body or "").encode()), warc.payload_digest((body or "").encode()),
                      *(("response", None) if kept[body or ""] == doc else ("revisit", kept[body or ""])))
                for doc, name, body, _ in rows}
    assert {r.doc_id: (r.file_name, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected
    order = [(r.url_key, r.written_at is not None, r.written_at or datetime.min, r.doc_id) for r in got]
    assert order == sorted(order)
    assert len({r.archive for r in got}) > 10
    contents = {r.path.rpartition("/")[2]: gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(folder).collect()}
    texts = {doc: body or "" for doc, _, body, _ in rows}
    for r in got:
        [(_, length, fields, block)] = warc.parse(contents[r.archive][r.offset:r.offset + r.length])
        assert length == r.length and fields["WARC-Type"] == r.record_type
        assert block.partition(b"\r\n\r\n")[2].decode() == (texts[r.doc_id] if r.record_type == "response" else "")


def test_repeated_rows_and_missing_ids(spark, tmp_path):
    rows = [(1, "a", "t", at(0)), (2, "b", "t", at(0)), (2, "b", "t", at(0)), (None, "c", "t", at(0)), (None, "c", "u", at(0))]
    found, _ = archived(spark, tmp_path, rows)
    assert sorted((str(r.doc_id), r.record_type, r.refers_to) for r in found.collect()) == [
        ("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("None", "response", None), ("None", "revisit", 2)]


def test_empty_table(spark, tmp_path):
    found, _ = archived(spark, tmp_path, [])
    assert found.count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(n):
    pick = random.Random(n)
    runs = [sorted(((pick.choice("abc"), at(pick.randrange(5)), pick.choice([None, *range(9)]), i, j)
                                  for j in range(pick.randrange(20))), key=warc._order) for i in range(n)]
    found = list(warc.merged(runs))
    assert sorted(map(repr, found)) == sorted(repr(r) for run in runs for r in run)
    assert [warc._order(r) for r in found] == sorted(warc._order(r) for r in found)


def test_url_key():
    assert warc.url_key("HTTP://user@WWW.Blog.Example.org:80/A/b/?y=2&x=1#top") == "org,example,blog)/a/b?x=1&y=2"
    assert [warc.url_key(u) for u in (None, "", "library/Doc.md")] == ["", "", "library/doc.md"]


def test_url_key_of_odd_uris():
    """Nothing raises, and what differs in scheme, user, port or fragment alone has one key."""
    assert warc.url_key("http://a\u2100b.com/x") == "com,a\u2100b)/x"
    assert warc.url_key("http://[::1]:8080/x?b&a") == "[::1]:8080)/x?a&b" and warc.url_key("http://[bad/x") == "[bad)/x"
    assert warc.url_key("//h.example") == warc.url_key("https://u:p@h.example:443/#f") == "example,h)"
    for odd in ("http://", "http:///p", "http://?q", "http://#", "a b//c", "http://x:port:80/y", "http://\x00\x7f/\n?\n#\n", "\u3002//", "h" * 9999 + "://x"):
        assert isinstance(warc.url_key(odd), str)
