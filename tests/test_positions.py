"""Position maps and the lookup of many passages, against short models."""

import random
import re
import time

import library as lib
import pytest

from marginalia.operators import positions
from marginalia.operators.passages import in_pages, located
from marginalia.operators.positions import Automaton, PositionMap, first_places, position_maps
from marginalia.plans import assembly
from marginalia.plans.assembly import whole_documents
from marginalia.plans.digest import digest
from marginalia.plans.export import corpus_export
from marginalia.operators.outline import flatten_outline

PARTS = ["a", "b", " ", "  ", "\n", "\t", "\xad", "\x02", "\x0b", "\x85", "\xa0", "\u3000", "\u200b", "é", "😀"]


def model(text):
    """Cleaned text and where each of its characters stands."""
    kept = [(i, c) for i, c in enumerate(text) if not re.match("[\xad\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", c)]
    out, places = [], []
    for i, c in kept:
        space = c in "\t\n\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000" or "\u2000" <= c <= "\u200a"
        if space and (not out or out[-1] == " "):
            continue
        out.append(" " if space else c)
        places.append(i)
    if out and out[-1] == " ":
        out.pop(), places.pop()
    return "".join(out), places


def texts(seed, count):
    pick = random.Random(seed)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randrange(30))) for _ in range(count)]


def test_every_place_leads_back():
    for text in texts(1, 3000):
        cleaned, places = model(text)
        own = PositionMap(text)
        assert own.cleaned == cleaned
        assert [own.source(i) for i in range(len(cleaned))] == places and own.source(len(cleaned)) == len(text)
        for source in range(len(text) + 1):
            assert own.rank(source) == sum(p < source for p in places)
        assert len(set(own.starts)) == len(own.starts) and all(a != b for a, b in zip(own.shifts, own.shifts[1:]))


def test_maps_as_a_table(spark):
    rows = [(i, t) for i, t in enumerate([*texts(2, 50), "", "plain text of one run", None])]
    found = {r.page_idx: r for r in position_maps(lib.page_text(spark, *rows)).collect()}
    for i, text in rows:
        own = PositionMap(text or "")
        assert [(r.start, r.shift) for r in found[i].runs] == list(zip(own.starts, own.shifts))
        assert (found[i].cleaned, found[i].size) == ((own.cleaned, len(text)) if text is not None else (None, None))
    assert len(found[len(rows) - 2].runs) == 1


def test_automaton_finds_first_places(monkeypatch):
    monkeypatch.setattr(positions, "FEW_PASSAGES", 2)
    monkeypatch.setattr(positions, "LONG_PASSAGE", 6)
    pick = random.Random(5)
    for _ in range(300):
        text = "".join(pick.choice("ab ") for _ in range(pick.randrange(60)))
        passages = {"".join(pick.choice("ab ") for _ in range(pick.randrange(1, 9))) for _ in range(pick.randrange(12))}
        assert first_places(text, passages) == {p: text.find(p) for p in passages if p in text}


def test_nested_passages_do_not_multiply():
    """Every suffix of what is read ends a passage; each is seen once."""
    passages = ["a" * n for n in range(1, 200)]
    automaton = Automaton()
    for passage in passages:
        automaton.add(passage)
    began = time.perf_counter()
    assert automaton.linked().first_places("a" * 100_000) == dict.fromkeys(passages, 0)
    assert time.perf_counter() - began < 5


def test_many_highlights_on_a_page(spark):
    """5,000 highlights on a page of 20,000 words; a quarter is found only as if the page were cleaned."""
    pick = random.Random(9)
    words = ["".join(pick.choice("abcdefghij") for _ in range(pick.randrange(2, 9))) for _ in range(20_000)]
    page = " ".join(w if pick.random() < 0.9 else w[:1] + "\xad" + w[1:] + " " for w in words)
    raws = []
    for place in range(5000):
        at = pick.randrange(len(words) - 12)
        raws.append((0, place, " ".join(words[at:at + pick.randrange(3, 12)]).upper() if place % 50 else "nowhere at all"))
    raw = lib.keyed(spark, "raw", raws)
    began = time.perf_counter()
    rows = [p for r in located(raw, lib.page_text(spark, (0, page))).collect() for p in r.places]
    assert time.perf_counter() - began < 30
    assert len(rows) == 5000 and sum(r.is_first for r in located(raw, lib.page_text(spark, (0, page))).select("is_first").collect()) == 1
    cleaned = PositionMap(page)
    for r in rows:
        if r.annot_idx % 50 == 0:
            assert r.start is None and r.shown == "nowhere at all"
            continue
        stretch = page[r.start - 1:r.start - 1 + r.size]
        assert PositionMap(stretch).cleaned.upper() == raws[r.annot_idx][2]
        assert cleaned.cleaned.upper().find(raws[r.annot_idx][2]) in (cleaned.rank(r.start - 1), -1) or page.upper().find(raws[r.annot_idx][2]) == r.start - 1


def test_passages_without_page_or_text(spark):
    raw = lib.keyed(spark, "raw", [(0, 0, "b  c"), (0, 1, " "), (0, 2, None), (1, 0, "x"), (2, 0, "y")])
    pages = lib.page_text(spark, (0, "a B\xad c d"), (1, ""), (3, "z"))
    found = {(r.page_idx, r.annot_idx): r.passage for r in in_pages(raw, pages).collect()}
    assert found == {(0, 0): "a **B\xad c** d", (0, 1): None, (0, 2): None, (1, 0): "**x**", (2, 0): "**y**"}


@pytest.mark.parametrize("limit", [1 << 20, 4096, 700])
def test_pieces_are_bounded(spark, monkeypatch, limit):
    """Whatever the limit, the text is the same and only a single block is longer."""
    monkeypatch.setattr(assembly, "PIECE_BYTES", limit)
    monkeypatch.setattr("marginalia.plans.export.PIECE_BYTES", limit)
    pick = random.Random(7)
    page = "The quiet harbour at dusk. " * 8
    rows = [lib.highlight(0, rects=[(50.0, float(pick.randrange(90)), 9.0, 9.0)], contents=pick.choice([None, "why", "é" * 900])) for _ in range(120)]
    rows += [lib.note(p, f"note {p}") for p in range(1, 40)] + [lib.caret(3, contents="x" * 3000)]
    headings = [(f"Heading number {p}", p) for p in range(40)]
    raw = lib.keyed(spark, "raw", [(0, i, pick.choice(["quiet  harbour", "at dusk", "not there"])) for i in range(120)])
    ann, ol, names = lib.annotations(spark, rows), flatten_outline(lib.outline(spark, headings)), lib.names(spark)
    texts = lib.page_text(spark, (0, page), (3, "short"), (50, "y" * 5000))
    pieces = digest(ann, ol, names, texts, raw).orderBy("piece_no").collect()
    exported = corpus_export(texts, ann, names, raw).orderBy("piece_no").collect()
    for found, kind in ((pieces, "digest"), (exported, "export")):
        assert [p.piece_no for p in found] == list(range(len(found)))
        for p in found:
            body = p.markdown.removeprefix("---\n\n")
            assert len(body.encode()) <= limit or body.count("\n\n") <= 1 or body.count("*(p. ") == 1
        joined = "".join(p.markdown for p in found)
        assert KEPT.setdefault(kind, joined) == joined
    assert (len(pieces) == 41) == (limit == 1 << 20) and KEPT["digest"].count("at **quiet") == 0 and KEPT["digest"].count("The **quiet harbour** at dusk") > 20


KEPT: dict[str, str] = {}


def test_page_of_100_000_highlights(spark):
    """200 MB of digest from one page, in pieces of a megabyte."""
    from pyspark.sql import functions as F
    ann = spark.range(100_000).selectExpr(
        "1L as doc_id", "0 as page_idx", "int(id) as annot_idx", "'highlight' as kind", "'#FF0' as color", "null as contents",
        "null as note_text", "null as author", "'None' as state", "float(0) as x", "float(0) as y", "float(0) as w", "float(0) as h",
        "array(struct(float(1) as x, float(id % 700) as y, float(1) as w, float(1) as h)) as rects", "cast(null as array<struct<x:float,y:float>>) as points")
    raw = ann.selectExpr("doc_id", "page_idx", "annot_idx", "concat('word', annot_idx % 400) as raw")
    page = " ".join(f"word{i}" for i in range(250))
    pieces = digest(ann, flatten_outline(lib.outline(spark, [("Coast", 0)])), lib.names(spark), lib.page_text(spark, (0, page)), raw)
    found = pieces.select("piece_no", F.octet_length("markdown").alias("size"), F.regexp_count("markdown", F.lit("highlight")).alias("n")).collect()
    assert sum(r.n for r in found if r.piece_no) == 100_000
    assert max(r.size for r in found) <= assembly.PIECE_BYTES and len(found) > 150
