"""Positions, boxes and pixels. Coordinates are 32-bit floats in PDF points."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Render resolution, points per inch, padding around a crop.
DPI = 300
POINTS_PER_INCH = 72.0
PADDING_PX = 40


def cell_of(coordinate: Column, size: float | Column) -> Column:
    """Place of a coordinate on a grid, as a whole double: no coordinate is too far out for it."""
    place = coordinate.cast("double") / size
    return place - F.pmod(place, F.lit(1.0))


def cells_between(first: Column, last: Column) -> Column:
    """The places from first to last, which must not be many."""
    return F.transform(F.sequence(F.lit(0), (last - first).cast("int")), lambda step: first + step)


def cell(col: Column, row: Column) -> Column:
    return F.struct(col.alias("col"), row.alias("row"))


def sort_y(kind: Column, y: Column, rects: Column, points: Column) -> Column:
    """Height that decides the reading order on a page; kinds without one lead with 0."""
    top = F.array_min(F.transform(points, lambda p: p["y"]))
    value = (F.when(kind == "highlight", F.get(rects, F.lit(0))["y"])
             .when(kind.isin("note", "rect"), y)
             .when(kind == "freehand", top))
    return F.coalesce(value, F.lit(0.0)).cast("double")


def stroke_bounds(points: Column) -> Column:
    """Smallest box around the points, null when there are none."""
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
                   F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))
    return F.when(F.array_size(points) > 0, box)


def bbox_gap(a: Column, b: Column) -> Column:
    """Distance between two boxes, 0 when they touch. Float arithmetic up to the root."""
    zero = F.lit(0.0).cast("float")
    dx = F.greatest(zero, a["min_x"] - b["max_x"], b["min_x"] - a["max_x"])
    dy = F.greatest(zero, a["min_y"] - b["max_y"], b["min_y"] - a["max_y"])
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def pixel_box(x: Column, y: Column, w: Column, h: Column, bmp_w: Column, bmp_h: Column) -> Column:
    """Padded crop box in the page picture, whose y axis points down.

    Null when off the page, or when any of the values is.
    """
    known = reduce(Column.__and__, (c.isNotNull() for c in (x, y, w, h, bmp_w, bmp_h)))
    left = F.greatest(F.lit(0), _pixels(x) - PADDING_PX)
    top = F.greatest(F.lit(0), bmp_h - _pixels(y + h) - PADDING_PX)
    width = F.least(_pixels(w) + 2 * PADDING_PX, bmp_w - left)
    height = F.least(_pixels(h) + 2 * PADDING_PX, bmp_h - top)
    box = F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"),
                   (left + width).cast("int").alias("right"),
                   (top + height).cast("int").alias("bottom"))
    return F.when(known & (width > 0) & (height > 0), box)


def _pixels(points: Column) -> Column:
    scaled = points.cast("double") * F.lit(DPI / POINTS_PER_INCH)
    return F.least(F.greatest(scaled, F.lit(-2.0**31)), F.lit(2.0**31 - 1)).cast("bigint")
