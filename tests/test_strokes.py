"""Stroke clusters and crops against brute force."""

import math
import random

import library as lib
import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions.geometry import bbox_gap, pixel_box
from marginalia.operators import links
from marginalia.operators import strokes as ops
from marginalia.operators.components import connected_components
from marginalia.operators.crops import crops, image_dirs, number_crops, pixel_boxes, with_images
from marginalia.operators.stored import stored


@pytest.fixture(autouse=True)
def no_small_pages(monkeypatch):
    """Grid cells, whatever the size of a page; tests of small pages set their size."""
    monkeypatch.setattr(ops, "SMALL_PAGE", 0)


def clusters_by_pairs(boxes):
    """Smallest member of each box's cluster; boxes are float32 rows, None without points."""
    parent = list(range(len(boxes)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for i, a in enumerate(boxes):
        for j in range(i):
            b = boxes[j]
            if a is None or b is None:
                continue
            dx = max(np.float32(0), a[0] - b[2], b[0] - a[2])
            dy = max(np.float32(0), a[1] - b[3], b[1] - a[3])
            if math.sqrt(dx * dx + dy * dy) <= 50.0:
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return [find(i) for i in range(len(boxes))]


def check(spark, pages):
    """pages: lists of strokes, a stroke being a list of points."""
    rows = [lib.freehand(p, *points) for p, strokes in enumerate(pages) for points in strokes]
    got = {(r.page_idx, r.annot_idx): r.cluster_idx
           for r in ops.stroke_clusters(lib.annotations(spark, rows)).collect()}
    for p, strokes in enumerate(pages):
        boxes = []
        for points in strokes:
            array = np.array(points, dtype=np.float32).reshape(-1, 2)
            boxes.append((*array.min(0), *array.max(0)) if len(points) else None)
        assert [got[p, i] for i in range(len(strokes))] == clusters_by_pairs(boxes), p
    return got


def scattered(rng, count, width, height, size):
    def stroke():
        x, y = rng.uniform(-width, width), rng.uniform(-height, height)
        return [(x + rng.uniform(0, size), y + rng.uniform(0, size)) for _ in range(rng.randrange(4))]
    return [stroke() for _ in range(count)]


def test_scattered_strokes(spark):
    rng = random.Random(3)
    pages = [scattered(rng, 60, 600, 700, 40) for _ in range(6)]
    pages += [scattered(rng, 25, 300, 300, 1), scattered(rng, 12, 500, 500, 300), [[], [], [(1.0, 1.0)]]]
    check(spark, pages)


def test_distances_at_the_limit(spark):
    chain = [[(0.0, float(50 * i))] for i in range(40)]
    broken = [[(0.0, 50.001 * i)] for i in range(10)]
    diagonal = [[(30.0 * i, 40.0 * i)] for i in range(30)]
    near = [[(0.0, 0.0)], [(30.0, 40.001)], [(-35.0, -35.0)], [(-35.0, 15.0)]]
    check(spark, [chain, broken, diagonal, near, list(reversed(chain))])


@pytest.mark.parametrize("few", [64, 3])
def test_crowded_cells_on_both_sides_of_the_limit(spark, monkeypatch, few):
    """Dense facing fronts, where hulls overlap the limit but only some strokes reach it."""
    monkeypatch.setattr(ops, "FEW_PIECES", few)
    rng = random.Random(4)
    pages = []
    for gap in (49.9, 50.2, 51.5, 48.0):
        left, right = [], []
        for _ in range(90):
            t = rng.uniform(0, 34)
            left.append([(t, 34.0 - t)])
            across, up = (gap + rng.uniform(0, 1)) / math.sqrt(2), (gap + rng.uniform(0, 1)) / math.sqrt(2)
            right.append([(t + across, 34.0 - t + up)])
        pages.append(left + right)
    check(spark, pages)


def test_crowded_page(spark):
    rng = random.Random(6)
    spots = [(0, 0), (100, 0), (0, 120), (400, 400), (451, 400)]
    page = [[(x + rng.uniform(0, 3), y + rng.uniform(0, 3))] for x, y in spots for _ in range(250)]
    rng.shuffle(page)
    assert len(set(check(spark, [page]).values())) == 4


def test_dense_groups_need_few_links(spark):
    """3,000 strokes on one spot, copies included, do not pair up."""
    rng = random.Random(8)
    rows = [lib.freehand(0, (rng.uniform(0, 30), rng.uniform(0, 30))) for _ in range(1500)]
    rows += [lib.freehand(0, (5.0, 5.0)) for _ in range(1500)]
    boxes = ops.stroke_boxes(lib.annotations(spark, rows)).withColumn("node", F.lit(0))
    assert ops.cell_links(boxes).count() == 0


def test_far_and_wide_strokes(spark):
    rng = random.Random(12)
    far = [[(1e12, 5.0)], [(1e12, 60.0)], [(1e12, 400.0)], [(-1e12, 5.0)], [(3e38, -3e38)], [(3e38, -3e38)], [(-3e38, 0.0)], [(0.0, 0.0)]]
    wide = [[(0.0, 0.0), (1e11, 10.0)], [(5e10, 55.0)], [(5e10, 300.0)], [(-40.0, -20.0)], [(-60.0, -20.0)], [(200.0, -1e12), (210.0, 1e12)],
            [(2000.0, 5000.0)], [(0.0, 5040.0), (9000.0, 5080.0)], [(9049.0, 5100.0), (9100.0, 9000.0)]]
    mixed = [*scattered(rng, 30, 3000, 3000, 60), *scattered(rng, 8, 3000, 3000, 5000)]
    check(spark, [far, wide, mixed])


def test_many_strokes_over_the_whole_page(spark):
    rng = random.Random(13)
    rows = [lib.freehand(0, (rng.uniform(0, 20), rng.uniform(0, 20)), (rng.uniform(590, 612), rng.uniform(770, 792))) for _ in range(5000)]
    rows += [lib.freehand(0, (700.0, 900.0)), lib.freehand(0, (660.0, 400.0))]
    found = {r.annot_idx: r.cluster_idx for r in ops.stroke_clusters(lib.annotations(spark, rows)).collect()}
    assert {found[i] for i in range(5000)} == {0} and found[5000] == 5000 and found[5001] == 0


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    nodes = rng.sample(range(10_000), 400)
    edges = [(1, a, b) for a, b in zip(nodes[:300], nodes[1:300])] + [
        (1, nodes[300], n) for n in nodes[301:]] + [(2, 5, 5), (2, 7, 6), (2, 6, 7)]
    rng.shuffle(edges)
    table = stored(spark.createDataFrame(edges, "k int, a long, b long").where("a <> b").distinct())
    found = {}
    for r in connected_components(table, ["k"]).collect():
        found.setdefault((r.k, r.component), set()).add(r.node)
    assert sorted(map(len, found.values())) == [2, 100, 300]


def test_gap_and_pixels(spark):
    def box(*sides):
        return F.struct(*(F.lit(v).cast("float").alias(n) for n, v in zip(ops.SIDES, sides)))

    def pixels(*values):
        return pixel_box(*(F.lit(v).cast("float") for v in values[:4]), *(F.lit(v).cast("int") for v in values[4:]))
    row = spark.range(1).select(
        bbox_gap(box(0, 0, 1, 1), box(4, 5, 6, 6)).alias("apart"),
        bbox_gap(box(0, 0, 9, 9), box(4, 5, 6, 6)).alias("inside"),
        pixels(50, 50, 400, 200, 2550, 3300).alias("plain"),
        pixels(0, 790, 10, 10, 2550, 3300).alias("corner"),
        pixels(600, 100, 10, 10, 1200, 3300).alias("off"),
        pixels(1e12, 0, 10, 10, 1200, 3300).alias("far"),
        pixels(0, 0, 1e12, 1e12, 1200, 3300).alias("huge"),
        pixels(0, 0, 9, 9, None, 3300).alias("no_page"),
        pixels(None, 0, 9, 9, 1200, 3300).alias("no_place")).first()
    assert row.no_page is None and row.no_place is None
    assert row.apart == 5.0 and row.inside == 0.0
    assert tuple(row.plain) == (168, 2219, 1914, 3132)
    assert tuple(row.corner) == (0, 0, 121, 121)
    assert row.off is None and row.far is None
    assert tuple(row.huge) == (0, 0, 1200, 3300)


def test_crop_numbers_skip_what_is_not_drawn(spark):
    rows = [lib.freehand(0, (10.0, 10.0)), lib.rect(0), lib.freehand(0, (300.0, 300.0)),
            lib.freehand(0, (12.0, 40.0)), lib.rect(0, x=5000.0), lib.freehand(0), lib.rect(1), lib.rect(2),
            lib.note(2, "n"), *(lib.rect(3) for _ in range(1000))]
    ann = lib.annotations(spark, rows)
    geometry = lib.table(spark, lib.schemas.PAGE_GEOMETRY, [
        {"doc_id": 1, "page_idx": p, "bmp_w": 2550, "bmp_h": 3300} for p in (0, 2, 3)])
    clusters = ops.stroke_clusters(ann)
    numbered = number_crops(pixel_boxes(ann, clusters, geometry), "").collect()
    assert sorted(r.crop_no for r in numbered) == list(range(1, 1005))
    dirs = image_dirs(lib.names(spark, (1, "a/paper.pdf")))
    own = crops(ann, clusters, geometry, dirs).where("page_idx = 2").first()
    assert own.image_path == "a/paper-annotations-images/annotation_004.png"
    assert with_images(ann, crops(ann, clusters, geometry, dirs)).where("page_idx = 2").orderBy(
        "annot_idx").first().image_path == "paper-annotations-images/annotation_004.png"
    images = {(r.page_idx, r.annot_idx): r.image_path for r in crops(ann, clusters, geometry, "d/").collect()}
    assert images[0, 1] == "d/annotation_001.png"
    assert images[0, 0] == images[0, 3] == "d/annotation_002.png"
    assert images[0, 2] == "d/annotation_003.png"
    assert images[2, 0] == "d/annotation_004.png"
    assert images[3, 999] == "d/annotation_1004.png"
    assert not images.keys() & {(0, 4), (0, 5), (1, 0), (2, 1)}


def test_small_pages(spark, monkeypatch):
    """Pages on both sides of the limit."""
    monkeypatch.setattr(ops, "SMALL_PAGE", 40)
    rng = random.Random(12)
    pages = [scattered(rng, count, 500, 500, 60) for count in (1, 2, 3, 12, 40, 41, 60, 25)]
    check(spark, [*pages, [[], []], [[(1e30, 0.0)], [(-1e30, 0.0)], [(1e30, 20.0)]]])


def links_by_pairs(boxes, max_gap):
    """Kruskal's algorithm over all pairs."""
    pairs = []
    for b, other in enumerate(boxes):
        for a in range(b):
            if boxes[a] is None or other is None:
                continue
            one = boxes[a]
            dx = max(np.float32(0), one[0] - other[2], other[0] - one[2])
            dy = max(np.float32(0), one[1] - other[3], other[1] - one[3])
            gap = math.sqrt(dx * dx + dy * dy)
            if gap <= max_gap:
                pairs.append((gap, one != other, a, b))
    own = list(range(len(boxes)))
    links = []
    for gap, _, a, b in sorted(pairs):
        if own[a] != own[b]:
            own = [own[a] if o == own[b] else o for o in own]
            links.append((a, b, gap))
    return sorted(links)


def float_boxes(strokes):
    arrays = [np.array(points, dtype=np.float32).reshape(-1, 2) for points in strokes]
    return [(*a.min(0), *a.max(0)) if len(a) else None for a in arrays]


@pytest.mark.parametrize("at_once,max_gap", [(1024, 50.0), (7, 200.0)])
def test_links_are_a_minimum_spanning_forest(spark, monkeypatch, at_once, max_gap):
    """One block a page, and many that Borůvka's rounds join; equal boxes and ties by rounded places."""
    monkeypatch.setattr(links, "BOXES_AT_ONCE", at_once)
    rng = random.Random(at_once)
    pages = [scattered(rng, 40, 400, 400, 50), scattered(rng, 9, 300, 300, 10), [[], [(0.0, 0.0)]],
             [[(float(rng.randrange(0, 300, 50)), float(rng.randrange(0, 300, 50)))] for _ in range(45)]]
    rows = [lib.freehand(p, *points) for p, strokes in enumerate(pages) for points in strokes]
    found = ops.stroke_links(lib.annotations(spark, rows), max_gap).collect()
    for p, strokes in enumerate(pages):
        assert sorted((r.a, r.b, r.gap) for r in found if r.page_idx == p) == links_by_pairs(float_boxes(strokes), max_gap)


def test_links_give_the_clusters_of_every_distance(spark, monkeypatch):
    monkeypatch.setattr(ops, "SMALL_PAGE", 256)
    rng = random.Random(31)
    page = scattered(rng, 80, 500, 500, 30)
    ann = stored(lib.annotations(spark, [lib.freehand(0, *points) for points in page]))
    found = ops.stroke_links(ann, 300.0).collect()
    own = list(range(len(page)))
    for r in found:
        if r.gap <= 50.0:
            own = [min(own[r.a], own[r.b]) if o in (own[r.a], own[r.b]) else o for o in own]
    assert own == [r.cluster_idx for r in ops.stroke_clusters(ann).orderBy("annot_idx").collect()]
    assert own == clusters_by_pairs(float_boxes(page))
