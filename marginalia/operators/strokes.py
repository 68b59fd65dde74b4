"""Freehand strokes: boxes, and clusters of strokes at most 50 points apart."""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.geometry import bbox_gap, cell, cell_of, cells_between, stroke_bounds
from marginalia.operators.blocks import ANNOTATION, PAGE, spread_join
from marginalia.operators.components import connected_components
from marginalia.operators.links import SIDES, forest, spanning_links
from marginalia.operators.stored import stored

# Fixed value: strokes this close, in points, share a crop.
MERGE_DISTANCE = 50.0

# Pages of at most so many strokes are solved each in one go.
SMALL_PAGE = 256
# Any two boxes that reach into one cell of this side are within the merge distance.
CELL = 35.0
# Cells this many steps apart can still hold boxes within the merge distance.
REACH = 2
# Squares of 4 by 4 cells bring near cells together.
SQUARE = 4
# Boxes over more cells than this in one direction, several pages wide, are not cut into pieces.
WIDEST = 64
# Cells with more pieces than this are not compared piece by piece but cut into parts first.
FEW_PIECES = 64
PARTS_PER_SIDE = 8
# Parts are not cut below this side, where coordinates have no more digits.
SMALLEST_PART = 1e-3


def stroke_boxes(ann: DataFrame) -> DataFrame:
    """The bounding box of every stroke, null for strokes without points."""
    return (ann.where(F.col("kind") == "freehand")
            .select(*ANNOTATION, stroke_bounds(F.col("points")).alias("_b"))
            .select(*ANNOTATION, *(F.col("_b")[side].alias(side) for side in SIDES)))


def stroke_links(ann: DataFrame, max_gap: float = MERGE_DISTANCE) -> DataFrame:
    """(doc_id, page_idx, a, b, gap): a minimum spanning forest of the strokes of each page, by annot_idx, a < b.

    Links of at most a distance, up to max_gap, make the clusters for it. Strokes without points have no links.
    """
    return spanning_links(stroke_boxes(ann), max_gap)


def stroke_clusters(ann: DataFrame) -> DataFrame:
    """Strokes with boxes and `cluster_idx`, the smallest annot_idx of their cluster.

    A cluster is a connected component of "at most 50 points apart". Pages of few strokes are solved each by itself,
    others together, by grid cells.
    """
    strokes = stroke_boxes(ann)
    large = stored(strokes.groupBy(*PAGE).agg(F.count("*").alias("n")).where(F.col("n") > SMALL_PAGE).select(*PAGE))
    wanted = F.struct("annot_idx", *SIDES)
    small = (strokes.join(large, PAGE, "left_anti").groupBy(*PAGE).agg(F.collect_list(wanted).alias("strokes"))
             .mapInArrow(_cluster_page, CLUSTERED).select(*PAGE, F.inline("strokes")))
    if large.isEmpty():
        return stored(small)
    return stored(small.unionByName(_clusters_by_cells(strokes.join(large, PAGE, "left_semi"))))


STROKE = [("annot_idx", pa.int32()), *((side, pa.float32()) for side in SIDES), ("cluster_idx", pa.int32())]
CLUSTERED = ("doc_id long, page_idx int, strokes array<struct<annot_idx int, min_x float, min_y float, max_x float, "
             "max_y float, cluster_idx int>>")


def _cluster_page(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch["strokes"].to_pylist()
        for strokes in pages:
            boxed = [s for s in strokes if s["min_x"] is not None]
            lowest = {s["annot_idx"]: s["annot_idx"] for s in strokes}
            if len(boxed) > 1:
                sides = np.array([[s[side] for side in SIDES] for s in boxed], np.float32)
                _hang(lowest, forest(np.array([s["annot_idx"] for s in boxed], np.int64), sides, MERGE_DISTANCE))
            for s in strokes:
                s["cluster_idx"] = lowest[s["annot_idx"]]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in PAGE), pa.array(pages, pa.list_(pa.struct(STROKE)))], [*PAGE, "strokes"])


def _hang(lowest: dict[int, int], links: list[tuple[int, int, float]]) -> None:
    """Set the lowest stroke of each cluster; at first each stroke is its own."""
    def top(stroke: int) -> int:
        while lowest[stroke] != stroke:
            stroke = lowest[stroke]
        return stroke
    for a, b, _ in links:
        low, high = sorted((top(a), top(b)))
        lowest[high] = low
    for stroke in lowest:
        lowest[stroke] = top(stroke)


def _clusters_by_cells(strokes: DataFrame) -> DataFrame:
    """Strokes are never paired up: those in one grid cell are linked through the cell, and two cells are linked when
    some of their strokes are close. Components are then found on cells, whose number depends on the page and
    not on how often it was drawn on.
    """
    strokes = strokes.withColumn("node", _first_cell())
    lowest = (strokes.where(F.col("node").isNotNull())
              .groupBy(*PAGE, "node").agg(F.min("annot_idx").alias("lowest")))
    linked = connected_components(cell_links(strokes), PAGE)
    named = (lowest.join(linked, [*PAGE, "node"], "left")
             .withColumn("component", F.coalesce("component", "node")))
    clusters = named.groupBy(*PAGE, "component").agg(F.min("lowest").alias("cluster_idx"))
    lookup = named.join(clusters, [*PAGE, "component"]).select(*PAGE, "node", "cluster_idx")
    found = spread_join(strokes, lookup, [*PAGE, "node"], "annot_idx")
    return found.withColumn("cluster_idx", F.coalesce("cluster_idx", "annot_idx")).drop("node")


def cluster_bounds(clusters: DataFrame) -> DataFrame:
    """The box around each cluster with points, as corner and size."""
    return (clusters.where(F.col("min_x").isNotNull()).groupBy(*PAGE, "cluster_idx")
            .agg(F.min("min_x").alias("x"), F.min("min_y").alias("y"),
                 F.max("max_x").alias("_right"), F.max("max_y").alias("_bottom"))
            .select(*PAGE, "cluster_idx", "x", "y", (F.col("_right") - F.col("x")).alias("w"),
                    (F.col("_bottom") - F.col("y")).alias("h")))


def cell_links(boxes: DataFrame) -> DataFrame:
    """Pairs (a, b) of cells whose strokes belong to one cluster, enough to connect all of it.

    A stroke counts for its first cell. Each cell it reaches into has an owner, the smallest
    first cell of the strokes there; links lead to owners and between owners of near cells.
    Wide boxes have a piece in their first cell only and are compared with all boxes of the page.
    """
    boxes = (boxes.where(F.col("min_x").isNotNull()).select(*PAGE, *SIDES).distinct()
             .withColumn("first", _first_cell()).withColumn("wide", _is_wide()))
    pieces = _cut(_first_piece_of_wide(boxes), CELL, "node")
    reached = pieces.select(*PAGE, "node", "first").distinct()
    owners = reached.groupBy(*PAGE, "node").agg(F.min("first").alias("owner"))
    reached = (reached.join(owners, [*PAGE, "node"]).where("first <> owner")
               .select(*PAGE, F.col("first").alias("a"), F.col("owner").alias("b"))
               .union(_wide_links(boxes)).distinct())
    cells = _hulls(pieces, ["node"], F.min("first").alias("owner"))
    near = _judged(_neighbours(cells)).select(
        *PAGE, F.col("owner_a").alias("a"), F.col("owner_b").alias("b"), "node_a", "node_b",
        "is_close", "is_small")
    links = stored(reached.withColumn("is_close", F.lit(True))
                   .unionByName(near, allowMissingColumns=True))
    sure = links.where("is_close").select(*PAGE, "a", "b")
    unsure = links.where("not is_close")
    if unsure.isEmpty():
        return sure
    return stored(sure.unionByName(_close_inside(pieces, unsure)))


def _cell(side: str, size: float) -> Column:
    return cell_of(F.col(side), size)


def _first_cell() -> Column:
    """The cell of the upper left corner, null for strokes without points."""
    return F.when(F.col("min_x").isNotNull(), cell(_cell("min_x", CELL), _cell("min_y", CELL)))


def _is_wide() -> Column:
    return F.greatest(_cell("max_x", CELL) - _cell("min_x", CELL), _cell("max_y", CELL) - _cell("min_y", CELL)) >= WIDEST


def _first_piece_of_wide(boxes: DataFrame) -> DataFrame:
    def cut(side: str, start: str) -> Column:
        edge = ((_cell(start, CELL) + 0.5) * CELL).cast("float")
        return F.when(F.col("wide"), F.greatest(start, F.least(side, edge))).otherwise(F.col(side)).alias(side)
    return boxes.select(*PAGE, "first", "min_x", "min_y", cut("max_x", "min_x"), cut("max_y", "min_y"))


def _wide_links(boxes: DataFrame) -> DataFrame:
    wide = _side(boxes.where("wide").drop("wide"), "a")
    met = wide.join(_side(boxes.drop("wide"), "b"), PAGE).where("first_a <> first_b")
    return (met.where(bbox_gap(_box("a"), _box("b")) <= MERGE_DISTANCE)
            .select(*PAGE, F.col("first_a").alias("a"), F.col("first_b").alias("b")).distinct())


def _cut(boxes: DataFrame, size: float, name: str) -> DataFrame:
    """Boxes cut along the grid, one piece for every cell they reach into."""
    kept = [c for c in boxes.columns if c not in SIDES]
    spread = (boxes
              .withColumn("_col", F.explode(cells_between(_cell("min_x", size), _cell("max_x", size))))
              .withColumn("_row", F.explode(cells_between(_cell("min_y", size), _cell("max_y", size)))))

    def edge(place: Column) -> Column:
        return (place * size).cast("float")
    return spread.select(*kept, cell(F.col("_col"), F.col("_row")).alias(name),
                         F.greatest("min_x", edge(F.col("_col"))).alias("min_x"),
                         F.greatest("min_y", edge(F.col("_row"))).alias("min_y"),
                         F.least("max_x", edge(F.col("_col") + 1)).alias("max_x"),
                         F.least("max_y", edge(F.col("_row") + 1)).alias("max_y"))


def _hulls(pieces: DataFrame, cell: list[str], *more: Column) -> DataFrame:
    """The box around the pieces of each cell, and their number."""
    return pieces.groupBy(*PAGE, *cell).agg(
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"),
        F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"),
        F.count("*").alias("pieces"), *more)


def _side(rows: DataFrame, side: str) -> DataFrame:
    """Name all columns of one of two sides, but for the page."""
    return rows.select(*PAGE, *(F.col(c).alias(f"{c}_{side}") for c in rows.columns if c not in PAGE))


def _box(side: str) -> dict[str, Column]:
    return {c: F.col(f"{c}_{side}") for c in SIDES}


def _neighbours(cells: DataFrame) -> DataFrame:
    """Pairs of cells within reach that do not have the same owner anyway.

    Cells meet in squares of cells: the one in its own square, the other in every square that
    holds a cell from which it is within reach.
    """
    def square(col: Column, row: Column) -> Column:
        return cell(cell_of(col, SQUARE), cell_of(row, SQUARE))
    places = cells.select("*", "node.*")
    reached = F.array_distinct(F.array(*(
        square(F.col("col_b") + dx, F.col("row_b") + dy) for dx in (-REACH, 0) for dy in (-REACH, REACH))))
    ahead = _side(places, "b").withColumn("_square", F.explode(reached))
    own = _side(places, "a").withColumn("_square", square(F.col("col_a"), F.col("row_a")))
    dx, dy = F.col("col_b") - F.col("col_a"), F.col("row_b") - F.col("row_a")
    return (own.join(ahead, [*PAGE, "_square"])
            .where(dx.between(0, REACH) & dy.between(-REACH, REACH) & ((dx > 0) | (dy > 0)))
            .where("owner_a <> owner_b"))


def _judged(pairs: DataFrame) -> DataFrame:
    """Pairs of cells that may hold close pieces; is_close where their hulls are proof of it.

    Some piece touches each side of a hull. Across a gap between hulls, two such pieces are as
    far apart as the hulls, and sideways no further than both hulls reach.
    """
    a, b = _box("a"), _box("b")

    def across(low: str, high: str) -> Column:
        return F.greatest(a[low] - b[high], b[low] - a[high]).cast("double")

    def reach(low: str, high: str) -> Column:
        return (F.greatest(a[high], b[high]) - F.least(a[low], b[low])).cast("double")
    gap_x, gap_y = across("min_x", "max_x"), across("min_y", "max_y")
    reach_x, reach_y = reach("min_x", "max_x"), reach("min_y", "max_y")
    surely = MERGE_DISTANCE - 1e-3
    proof = ((F.hypot(reach_x, reach_y) <= surely)
             | ((gap_x > 0) & (F.hypot(gap_x, reach_y) <= surely))
             | ((gap_y > 0) & (F.hypot(reach_x, gap_y) <= surely)))
    single = (F.col("pieces_a") == 1) & (F.col("pieces_b") == 1)
    small = (F.col("pieces_a") <= FEW_PIECES) & (F.col("pieces_b") <= FEW_PIECES)
    return (pairs.where(bbox_gap(a, b) <= MERGE_DISTANCE)
            .withColumn("is_close", single | proof).withColumn("is_small", small))


def _close_inside(pieces: DataFrame, unsure: DataFrame) -> DataFrame:
    """The unsure links (a, b) whose cells do hold close pieces.

    Pieces of two cells meet only when they are few. Other cells are cut into parts, which are
    judged like cells, and so on until every pair is settled.
    """
    link = [*PAGE, "a", "b"]
    cells = unsure.select(*PAGE, F.explode(F.array("node_a", "node_b")).alias("node")).distinct()
    pieces = stored(pieces.join(cells, [*PAGE, "node"])
                    .select(*PAGE, "node", _no_part().alias("part"), *SIDES))
    unsure = unsure.select(*link, "node_a", "node_b", _no_part().alias("part_a"),
                           _no_part().alias("part_b"), "is_small")
    size, found = CELL, []
    while True:
        last = size / PARTS_PER_SIDE < SMALLEST_PART
        few = unsure if last else unsure.where("is_small")
        met = _join_sides(few, pieces).where(bbox_gap(_box("a"), _box("b")) <= MERGE_DISTANCE)
        found.append(stored(met.select(*link).distinct()))
        many = unsure.where("not is_small").join(found[-1], link, "left_anti")
        if last or many.isEmpty():
            break
        size /= PARTS_PER_SIDE
        cells = many.select(*PAGE, F.explode(F.array(
            F.struct(F.col("node_a").alias("node"), F.col("part_a").alias("part")),
            F.struct(F.col("node_b").alias("node"), F.col("part_b").alias("part")))).alias("_c"))
        parts = pieces.join(cells.select(*PAGE, "_c.*").distinct(), [*PAGE, "node", "part"])
        pieces = stored(_cut(parts.withColumnRenamed("part", "whole"), size, "part").distinct())
        hulls = _hulls(pieces, ["node", "whole", "part"])
        whole = many.drop("is_small").withColumnsRenamed({"part_a": "whole_a", "part_b": "whole_b"})
        judged = stored(_judged(_join_sides(whole, hulls, "whole")).select(
            *link, "node_a", "node_b", "part_a", "part_b", "is_close", "is_small"))
        found.append(judged.where("is_close").select(*link).distinct())
        unsure = judged.where("not is_close").join(found[-1], link, "left_anti")
        pieces = pieces.drop("whole")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def _no_part() -> Column:
    return cell(F.lit(0.0), F.lit(0.0))


def _join_sides(pairs: DataFrame, rows: DataFrame, key: str = "part") -> DataFrame:
    return (pairs.join(_side(rows, "a"), [*PAGE, "node_a", f"{key}_a"])
            .join(_side(rows, "b"), [*PAGE, "node_b", f"{key}_b"]))
