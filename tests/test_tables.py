"""Outlines, headings, numbering, filters and tables."""

import random

import library as lib
import pytest
from pyspark.sql import functions as F

from marginalia.operators import blocks, outline, sections
from marginalia.operators.filters import filter_annotations, filter_colors, filter_report
from marginalia.operators.outline import dedup_outline, flatten_outline, loose_entries
from marginalia.operators.stored import stored
from marginalia.operators.summary import document_totals, page_counts, section_summary
from marginalia.plans.digest import annotation_digest, digest_files
from marginalia.sources import tables
from marginalia.sources.tables import read_annotations, write_digests


def random_outline(rng, depth=0):
    entries = []
    for _ in range(rng.randrange(1, 5)):
        page = rng.choice([None, rng.randrange(30)])
        below = [random_outline(rng, depth + 1)] if depth < 4 and rng.random() < 0.5 else []
        entries.append((rng.choice("ABCDE"), page, *below))
    return entries


def preorder(entries, depth=0):
    for title, page, *children in entries:
        yield title, page, depth
        yield from preorder(children[0] if children else [], depth + 1)


def test_outline_order_and_depth(spark):
    tree = random_outline(random.Random(1))
    rows = flatten_outline(lib.outline(spark, tree)).orderBy("outline_key").collect()
    assert [(r.title, r.page_idx, r.depth) for r in rows] == list(preorder(tree))


def test_outline_without_roots_is_empty(spark):
    loop = lib.table(spark, lib.schemas.OUTLINE_ENTRIES, [
        {"doc_id": 1, "id": 1, "parent_id": 2, "sibling_ord": 0, "title": "x"},
        {"doc_id": 1, "id": 2, "parent_id": 1, "sibling_ord": 0, "title": "y"}])
    assert flatten_outline(loop).isEmpty()
    assert loose_entries(loop, flatten_outline(loop)).count() == loop.count()


def test_large_outlines_are_joined_level_by_level(spark, monkeypatch):
    """Both ways give the same, on both sides of the limit; repeated ids have the same children."""
    rng = random.Random(44)
    entries = lib.outline(spark, random_outline(rng), doc_id=1).union(lib.outline(spark, random_outline(rng) * 6, doc_id=2))
    entries = stored(entries.union(entries.where("doc_id = 2 and parent_id is null")))
    walked = sorted(map(tuple, flatten_outline(entries).collect()), key=repr)
    monkeypatch.setattr(outline, "SMALL_OUTLINE", min(r["count"] for r in entries.groupBy("doc_id").count().collect()))
    assert sorted(map(tuple, flatten_outline(entries).collect()), key=repr) == walked
    monkeypatch.setattr(outline, "SMALL_OUTLINE", 0)
    assert sorted(map(tuple, flatten_outline(entries).collect()), key=repr) == walked


@pytest.mark.parametrize("pages_per_block", [1024, 3])
def test_headings_against_a_scan(spark, monkeypatch, pages_per_block):
    monkeypatch.setattr(blocks, "PAGES_PER_BLOCK", pages_per_block)
    rng = random.Random(7)
    trees = {d: random_outline(rng) for d in range(8)}
    trees[8] = []
    ol, rows = None, []
    for d, tree in trees.items():
        one = lib.outline(spark, tree, d)
        ol = one if ol is None else ol.unionByName(one)
        rows += [lib.note(rng.randrange(35), "x", doc_id=d) for _ in range(40)]
    got = sections.assign_headings(lib.annotations(spark, rows), flatten_outline(ol)).collect()
    assert len(got) == len(rows)
    for r in got:
        entries = list(preorder(trees[r.doc_id]))
        first = {}
        for title, page, depth in entries:
            first.setdefault((title, page), depth)
        ordered = sorted((e for e in entries if e[1] is not None), key=lambda e: e[1])
        before = [e for e in ordered if e[1] <= r.page_idx]
        if before:
            title, page, _ = before[-1]
            assert (r.title, r.depth) == (title, first[title, page])
        else:
            assert (r.title, r.depth, r.outline_key) == (None, None, "~")


def test_dedup_keeps_the_first(spark):
    tree = [("A", 1, [("B", 1)]), ("B", 1), ("A", None), ("A", None), ("A", 1)]
    rows = dedup_outline(flatten_outline(lib.outline(spark, tree))).orderBy("outline_key").collect()
    assert [(r.title, r.page_idx, r.depth) for r in rows] == [("A", 1, 0), ("B", 1, 1), ("A", None, 0)]


@pytest.mark.parametrize("size", [65536, 4])
def test_reading_order_rank(spark, monkeypatch, size):
    monkeypatch.setattr(sections, "annot_block", lambda: blocks.block_of(sections.F.col("annot_idx"), size))
    monkeypatch.setattr(blocks, "PAGES_PER_BLOCK", 2)
    rng = random.Random(11)
    rows = [lib.note(rng.randrange(9), "x", y=rng.choice([0.0, -3.5, 2.25, 2.75, rng.uniform(-9, 9)]))
            for _ in range(120)]
    assigned = sections.assign_headings(lib.annotations(spark, rows),
                                        flatten_outline(lib.outline(spark, [("A", 3), ("B", 6)])))
    got = sections.reading_order(assigned).collect()
    for key in {r.outline_key for r in got}:
        mine = sorted((r for r in got if r.outline_key == key),
                      key=lambda r: (r.page_idx, r.sort_y, r.annot_idx))
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("size", [65536, 3])
def test_colour_filter_numbers_what_is_left(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", size)
    rng = random.Random(12)
    colors = [rng.choice(["#F00", "ff0000", "#00F", None]) for _ in range(60)]
    ann = lib.annotations(spark, [lib.note(i % 2, str(i), color=c) for i, c in enumerate(colors)])
    kept = filter_colors(ann, "f00").orderBy("page_idx", "annot_idx").collect()
    for page in (0, 1):
        mine = [r for r in kept if r.page_idx == page]
        assert [r.annot_idx for r in mine] == list(range(len(mine)))
        assert [r.note_text for r in mine] == [
            str(i) for i, c in enumerate(colors) if i % 2 == page and c in ("#F00", "ff0000")]


def test_filters_and_report(spark):
    ann = lib.annotations(spark, [lib.note(0, "a"), lib.note(0, "b", color="#00F"), lib.note(2, "c"),
                                  lib.note(0, "d", doc_id=2)])
    entries = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "doc_id long, page_idx int")
    assert [r.note_text for r in filter_annotations(ann, "1", "00f").collect()] == ["b"]

    def report(**filters):
        return {r.doc_id: (r.annotations, r.pages) for r in filter_report(ann, entries, **filters).collect()}
    assert report() == {1: (3, 3), 2: (1, 1)}
    assert report(page_range="2-") == {1: (1, 2)}
    assert report(colors="00f") == {1: (1, 1)}


def test_counts(spark):
    ann = lib.annotations(spark, [lib.note(0, "a"), lib.rect(0), lib.caret(4), {"page_idx": 4, "kind": None}])
    totals = document_totals(page_counts(ann)).first()
    assert (totals.annotations, totals.pages) == (4, 2)
    rows = section_summary(ann, flatten_outline(lib.outline(spark, [("A", 1)]))).collect()
    assert sorted((r.title or "", r.highlights, r.notes, r.rectangles, r.freehand, r.other) for r in rows) == [
        ("", 0, 1, 1, 0, 0), ("A", 0, 0, 0, 0, 2)]


def test_spread_join_shuffles_the_lookup_once(spark):
    rows = spark.range(3).selectExpr("id as k", "int(id) as i")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = blocks.spread_join(rows, spark.range(3).withColumnRenamed("id", "k"), ["k"], "i")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1


def test_spread_join_splits_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", 100)
    rows = spark.range(1000).selectExpr("cast(1 as bigint) as k", "cast(id as int) as i")
    lookup = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    joined = blocks.spread_join(rows, lookup, ["k"], "i")
    assert joined.where("v = 'x'").count() == 1000 and joined.columns == ["k", "i", "v"]


def test_reading_order_of_a_crowded_page(spark, monkeypatch):
    """One page with distinct heights, blocks of three rows."""
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", 3)
    rng = random.Random(3)
    rows = [lib.note(0, "n", y=rng.choice([rng.uniform(-40, 800), 7.0, 1e30, -1e30])) for _ in range(200)] + [lib.caret(0) for _ in range(20)]
    ann = lib.annotations(spark, rows).withColumn("outline_key", F.lit("~"))
    found = {r.annot_idx: r["rank"] for r in sections.reading_order(ann).collect()}
    heights = {r.annot_idx: r.sort_y for r in sections.with_sort_y(ann).collect()}
    order = sorted(heights, key=lambda i: (heights[i], i))
    assert [found[i] for i in order] == list(range(1, 221))


def test_tables_round_trip(spark, tmp_path):
    ann = lib.annotations(spark, [lib.highlight(0, author="Ada"), lib.freehand(1, (1.0, 2.0))])
    for kind in ("parquet", "json"):
        path = str(tmp_path / kind)
        ann.write.format(kind).save(path)
        back = read_annotations(spark, path, kind)
        assert back.orderBy("page_idx").collect() == ann.orderBy("page_idx").collect()
    marked = ann.withColumn("kind", F.when(F.col("kind") == "highlight", "squiggly").otherwise(F.col("kind")))
    marked.write.parquet(str(tmp_path / "marked"))
    assert {r.kind for r in read_annotations(spark, str(tmp_path / "marked")).collect()} == {"highlight", "freehand"}


def test_digest_from_tables_as_they_are_read(spark, tmp_path):
    ann = lib.annotations(spark, [lib.highlight(0, kind="underline"), lib.note(2, "later"), lib.rect(2)])
    glyphs = lib.table(spark, lib.schemas.GLYPHS, [
        {"doc_id": 1, "page_idx": 0, "glyph_idx": i, "ch": ch, "x0": 60.0 + 6 * i, "y0": 50.0, "x1": 66.0 + 6 * i, "y1": 60.0}
        for i, ch in enumerate("ebb")])
    geometry = lib.table(spark, lib.schemas.PAGE_GEOMETRY, [{"doc_id": 1, "page_idx": 2, "bmp_w": 2550, "bmp_h": 3300}])
    made = {"annotations": ann, "outline": lib.outline(spark, [("Tides", 0)]), "page_text": lib.page_text(spark, (0, "at ebb tide")),
            "glyphs": glyphs, "geometry": geometry, "names": lib.names(spark, (1, "sea/tides.pdf"))}
    read = {}
    for name, table in made.items():
        table.write.parquet(str(tmp_path / name))
        read[name] = getattr(tables, f"read_{name}")(spark, str(tmp_path / name))
        assert read[name].schema.simpleString() == table.schema.simpleString()
    pieces = annotation_digest(read["annotations"], flatten_outline(read["outline"]), read["names"], read["page_text"],
                               read["glyphs"], read["geometry"])
    write_digests(digest_files(pieces), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id", "piece_no").collect()
    assert [r.piece_no for r in back] == [0, 1, 2] and {r.file_name for r in back} == {"sea/tides-annotations.md"}
    assert "> at **ebb** tide\n>\n> *(p. 1, highlight)*" in back[1].markdown
    assert "![Rectangle annotation, p. 3](tides-annotations-images/annotation_001.png)" in back[2].markdown


def test_pieces_are_written_in_order(spark, tmp_path):
    rows = [(d, "n", p, f"{d}.{p}", "f") for p in range(40) for d in range(5)]
    write_digests(spark.createDataFrame(rows, "doc_id long, name string, piece_no long, markdown string, file_name string"),
                  str(tmp_path / "out"))
    for file in (tmp_path / "out").glob("*.parquet"):
        found = [(r.doc_id, r.piece_no) for r in spark.read.parquet(str(file)).collect()]
        assert found == sorted(found)


def test_stored_tables_go_to_the_checkpoint_folder(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert stored(spark.range(3)).count() == 3
    assert any(tmp_path.rglob("*.parquet"))
