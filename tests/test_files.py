"""Nested annotation and outline files."""

import json

import library as lib

from marginalia.operators.outline import flatten_outline
from marginalia.sources import files


def read(spark, *contents):
    rows = [(i, c if isinstance(c, str) or c is None else json.dumps(c)) for i, c in enumerate(contents)]
    records = files.annotation_records(spark.createDataFrame(rows, files.FILES))
    return sorted((tuple(r) for r in files.errors_of(records).collect()), key=repr), files.annotations_of(records).orderBy(
        "doc_id", "page_idx", "annot_idx").collect()


def test_kinds_fields_and_places(spark):
    errors, found = read(spark, {"version": 2, "pages": {"10": [
        {"type": "HighlightAnnotation", "color": "#FF0", "rects": [{"x": 1, "y": 2.5, "w": 3, "h": 4}, {"X": 1, "Y": 2, "W": 3, "H": 4}]},
        {"type": "text_note", "X": 500, "y": 300, "text": "Clarify", "contents": None, "state": "Accepted", "author": "A"},
        {"Type": "Freehand", "points": [{"x": 100, "y": 200}]}, {"type": "caret", "w": "7"}, {"type": "free-text", "contents": "In the margin"},
        {"type": "sticker", "glue": {"deep": [1, [2, {"a": 3}]]}}, {"type": "squiggly", "rects": []}], "2": []}}, None, {"other": 1}, {"pages": None})
    assert not errors
    assert [(r.page_idx, r.annot_idx, r.kind) for r in found] == [
        (10, i, k) for i, k in enumerate(["highlight", "note", "freehand", "caret", "free_text", "sticker", "highlight"])]
    assert found[0].color == "#FF0" and [tuple(r) for r in found[0].rects] == [(1.0, 2.5, 3.0, 4.0), (1.0, 2.0, 3.0, 4.0)]
    assert (found[1].x, found[1].y, found[1].note_text, found[1].contents, found[1].state, found[1].author) == (500.0, 300.0, "Clarify", None, "Accepted", "A")
    assert [tuple(p) for p in found[2].points] == [(100.0, 200.0)] and found[3].w == 7.0 and found[6].rects == []


def test_what_cannot_be_read_is_kept_apart(spark):
    bad = ['{"pages": {', {"pages": [1]}, {"pages": {"one": [{"type": "note"}]}}, {"pages": {"3": {"type": "note"}}},
           {"pages": {"4": [5, {"color": "red"}, {"type": "rect", "x": "wide"}, {"type": "freehand", "points": [{"x": 1}]}, {"type": "note"}]}}]
    errors, found = read(spark, *bad)
    assert [e[:4] for e in errors] == sorted([(0, None, None, "not JSON"), (1, None, None, "pages"), (2, None, None, "page number"),
                                              (3, 3, None, "page"), (4, 4, 0, "record"), (4, 4, 1, "kind"), (4, 4, 2, "field"), (4, 4, 3, "field")], key=repr)
    assert dict((e[3], e[4]) for e in errors)["not JSON"] == bad[0] and all(e[4] for e in errors)
    assert [(r.doc_id, r.annot_idx, r.kind) for r in found] == [(4, 4, "note")]


def test_files_below_a_path(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "sea tides.pdf.annotations.json").write_text('{"pages": {"0":\n [{"type": "caret"}]}}')
    (tmp_path / "b.pdf.annotations.json").write_text("no")
    (tmp_path / "c.pdf.annotations.json").write_text("{}")
    found, errors = files.read_annotation_files(spark, str(tmp_path), lib.names(spark, (7, "x/sea tides.pdf"), (8, "b.pdf")))
    assert [(r.doc_id, r.page_idx, r.kind) for r in found.collect()] == [(7, 0, "caret")]
    assert [(r.doc_id, r.reason) for r in errors.collect()] == [(8, "not JSON")]


def test_outlines_of_any_depth(spark):
    headings = [("A", 0, [("A1", 1, [("A11", None), ("A12", 3)]), ("A2", 4)]), ("B", None)]

    def nested(entries):
        return [{"title": t, **({} if p is None else {"Page": p}), "children": nested(c[0] if c else [])} for t, p, *c in entries]
    expected = sorted(map(tuple, flatten_outline(lib.outline(spark, headings, doc_id=0)).drop("id").select(
        "doc_id", "title", "page_idx", "depth", "outline_key").collect()))
    deep: list = []
    for level in range(60, 0, -1):
        deep = [{"Title": f"L{level}", "Children": deep}]
    rows = [(0, json.dumps(nested(headings))), (1, json.dumps({"outline": deep})), (2, "no"), (3, "[]"), (4, None), (5, "[1, {}]")]
    found = files.outline_of(spark.createDataFrame(rows, files.FILES)).collect()
    assert sorted(tuple(r) for r in found if r.doc_id == 0) == expected
    assert [(r.title, r.depth) for r in sorted((r for r in found if r.doc_id == 1), key=lambda r: r.depth)] == [(f"L{i + 1}", i) for i in range(60)]
    assert [(r.doc_id, r.title, r.outline_key) for r in found if r.doc_id > 1] == [(5, "", "1".zfill(19))]
