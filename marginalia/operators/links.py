"""Freehand strokes joined by their shortest gaps: a minimum spanning forest for each page.

The forest has at most one link less than the page has strokes, and the clusters for every distance: two strokes
belong together at a distance if links no longer than it lead from one to the other. No list of all
pairs is ever made. Shorter links come first, of equal ones those between equal boxes, then those of the lowest
ends, so the forest is the same whatever it is made from.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.geometry import bbox_gap
from marginalia.operators.blocks import PAGE, block_of, number_rows, spread_join
from marginalia.operators.components import connected_components
from marginalia.operators.stored import stored

SIDES = ["min_x", "min_y", "max_x", "max_y"]
# Boxes that are compared with each other at once, and the height in points of the bands they are taken from.
BOXES_AT_ONCE, BAND = 1024, 144.0

LINK = "doc_id long, page_idx int, a int, b int, gap double"


def spanning_links(boxes: DataFrame, max_gap: float) -> DataFrame:
    """(doc_id, page_idx, a, b, gap): links of at most max_gap between boxes (doc_id, page_idx, annot_idx and sides).

    Equal boxes hang on the first of them. Of the others, blocks of neighbours are compared, each with itself and
    with all blocks close enough; what such a comparison leaves out is in no forest. Pages of one block are
    done then, larger ones are joined by Borůvka's rounds over what is left.
    """
    boxes = boxes.where(F.col("min_x").isNotNull()).select(*PAGE, "annot_idx", *SIDES)
    firsts = boxes.groupBy(*PAGE, *SIDES).agg(F.min("annot_idx").alias("first"))
    equal = (spread_join(boxes, firsts, [*PAGE, *SIDES], "annot_idx", "inner").where("annot_idx <> first")
             .select(*PAGE, F.col("first").alias("a"), F.col("annot_idx").alias("b"), F.lit(0.0).alias("gap")))
    placed = stored(_in_blocks(firsts.withColumnRenamed("first", "annot_idx")))
    pairs = _near_blocks(placed, max_gap)
    met = (placed.join(pairs, [*PAGE, "block"]).groupBy(*PAGE, "one", "other", "n_blocks")
           .agg(F.collect_list(F.struct("annot_idx", *SIDES)).alias("boxes")).where(F.size("boxes") > 1))
    found = met.mapInArrow(_linker(max_gap), LINK + ", is_done boolean")
    found = stored(found.distinct())
    links = found.where("is_done").drop("is_done").unionByName(equal)
    open_ = found.where("not is_done").drop("is_done")
    return links if open_.isEmpty() else links.unionByName(_joined(open_))


def _in_blocks(boxes: DataFrame) -> DataFrame:
    """Boxes with the block they are in, along bands of the page."""
    band = F.floor(F.col("min_y").cast("double") / BAND)
    rows = number_rows(boxes.withColumn("_band", band), PAGE, [["_band"]], ["min_x", "annot_idx"], "_no").drop("_band")
    return rows.withColumn("block", block_of(F.col("_no") - 1, BOXES_AT_ONCE)).drop("_no")


def _near_blocks(placed: DataFrame, max_gap: float) -> DataFrame:
    """(doc_id, page_idx, block, one, other, n_blocks): the pairs each block takes part in, itself with itself as well."""
    hulls = stored(placed.groupBy(*PAGE, "block").agg(
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y")))
    counts = hulls.groupBy(*PAGE).agg(F.count("*").alias("n_blocks"))
    one = hulls.select(*PAGE, F.col("block").alias("one"), *(F.col(s).alias(f"{s}_one") for s in SIDES))
    other = hulls.select(*PAGE, F.col("block").alias("other"), *(F.col(s).alias(f"{s}_other") for s in SIDES))
    gap = bbox_gap({s: F.col(f"{s}_one") for s in SIDES}, {s: F.col(f"{s}_other") for s in SIDES})
    met = one.join(other, PAGE).where((F.col("one") <= F.col("other")) & (gap <= max_gap)).join(counts, PAGE)
    return met.select(*PAGE, F.explode(F.array_distinct(F.array("one", "other"))).alias("block"), "one", "other", "n_blocks")


def _linker(max_gap: float):
    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, page, n_blocks, boxes in zip(*(batch[c].to_pylist() for c in (*PAGE, "n_blocks", "boxes")), strict=True):
                ids = np.array([b["annot_idx"] for b in boxes], np.int64)
                sides = np.array([[b[s] for s in SIDES] for b in boxes], np.float32)
                rows += [(doc, page, a, b, gap, n_blocks == 1) for a, b, gap in forest(ids, sides, max_gap)]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             [*PAGE, "a", "b", "gap", "is_done"])
    return link


def forest(ids: np.ndarray, sides: np.ndarray, max_gap: float) -> list[tuple[int, int, float]]:
    """Prim's algorithm on boxes (n x 4 floats); links as (lower id, higher id, gap)."""
    order = np.argsort(ids)
    ids, sides = ids[order], sides[order]
    outside = np.ones(len(ids), bool)
    gaps = np.full(len(ids), np.inf)
    ends = np.full(len(ids), -1)
    links = []
    at = 0
    for _ in range(len(ids)):
        outside[at] = False
        new = _gaps(sides[at], sides)
        new[new > max_gap] = np.inf
        closer = outside & ((new < gaps) | ((new == gaps) & (new < np.inf) & _before(at, ends, np.arange(len(ids)))))
        gaps[closer], ends[closer] = new[closer], at
        left = np.flatnonzero(outside)
        if not len(left):
            break
        least = gaps[left].min()
        if least == np.inf:
            at = int(left[0])
            continue
        best = left[gaps[left] == least]
        at = int(best[np.lexsort((np.maximum(best, ends[best]), np.minimum(best, ends[best])))[0]])
        a, b = sorted((at, int(ends[at])))
        links.append((int(ids[a]), int(ids[b]), float(least)))
    return links


def _before(at: int, ends: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether the link from own to at comes before the one from own to its end."""
    low, low_end = np.minimum(at, own), np.minimum(ends, own)
    return (low < low_end) | ((low == low_end) & (np.maximum(at, own) < np.maximum(ends, own)))


def _gaps(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Like bbox_gap: 32-bit floats up to the root."""
    with np.errstate(over="ignore", invalid="ignore"):
        dx = np.maximum(np.float32(0), np.maximum(box[0] - others[:, 2], others[:, 0] - box[2]))
        dy = np.maximum(np.float32(0), np.maximum(box[1] - others[:, 3], others[:, 1] - box[3]))
        return np.sqrt((dx * dx + dy * dy).astype(np.float64))


def _joined(links: DataFrame) -> DataFrame:
    """Borůvka: in each round every component takes its first link to another one."""
    links = links.select(*PAGE, F.struct("gap", "a", "b").alias("link"), F.col("a").alias("one"), F.col("b").alias("other"))
    taken = None
    while True:
        ends = links.select(*PAGE, "link", F.explode(F.array("one", "other")).alias("end"))
        best = stored(ends.groupBy(*PAGE, "end").agg(F.min("link").alias("link")).select(*PAGE, "link").distinct())
        taken = best if taken is None else taken.unionByName(best)
        chosen = links.join(best, [*PAGE, "link"], "left_semi")
        component = connected_components(stored(chosen.select(*PAGE, F.col("one").alias("a"), F.col("other").alias("b"))), PAGE)
        component = stored(component)
        for end in ("one", "other"):
            names = component.select(*PAGE, F.col("node").alias(end), "component")
            links = (links.join(names, [*PAGE, end], "left").withColumn(end, F.coalesce("component", end)).drop("component"))
        links = stored(links.where("one <> other"))
        if links.isEmpty():
            return taken.select(*PAGE, "link.a", "link.b", "link.gap")
