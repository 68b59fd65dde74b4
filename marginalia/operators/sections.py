"""Which heading an annotation belongs to, and in which order a section is read."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.geometry import sort_y
from marginalia.operators.blocks import (
    ANNOTATION, PAGE, annot_block, number_rows, page_block, spread_join)
from marginalia.operators.outline import NO_HEADING, page_headings
from marginalia.operators.stored import stored

# Height of a line, in points, by which a page is cut where annotations are numbered.
LINE = 0.25


def headings_at(pages: DataFrame, ol: DataFrame) -> DataFrame:
    """Rows of distinct pages with title, depth and outline_key of the nearest heading at or
    before the page; without one, nulls and the key `~`.

    An as-of join at page grain. Within a block of pages a running `last` carries the heading
    forward; what the block starts with is the last heading of the blocks before it.
    """
    others = [c for c in pages.columns if c not in PAGE]
    marks = (pages.withColumn("_asked", F.lit(True))
             .unionByName(page_headings(ol), allowMissingColumns=True)
             .withColumn("_block", page_block()).repartition("doc_id", "_block")
             .groupBy(*PAGE, "_block")
             .agg(*(F.max(c).alias(c) for c in [*others, "_asked", "heading"])))
    within = Window.partitionBy("doc_id", "_block").orderBy("page_idx")
    earlier = (Window.partitionBy("doc_id").orderBy("_block")
               .rowsBetween(Window.unboundedPreceding, -1))
    heading_page = F.when(F.col("heading").isNotNull(), F.col("page_idx"))
    carried = (marks.groupBy("doc_id", "_block")
               .agg(F.max_by("heading", heading_page).alias("heading"))
               .select("doc_id", "_block",
                       F.last("heading", ignorenulls=True).over(earlier).alias("_carried")))
    found = (marks.withColumn("_within", F.last("heading", ignorenulls=True).over(within))
             .where("_asked").join(carried, ["doc_id", "_block"])
             .withColumn("_found", F.coalesce("_within", "_carried")))
    return found.select(*PAGE, *others, "_found.title", "_found.depth",
                        F.coalesce("_found.outline_key", F.lit(NO_HEADING)).alias("outline_key"))


def annotated_pages(ann: DataFrame) -> DataFrame:
    return ann.select(*PAGE).distinct()


def assign_headings(ann: DataFrame, ol: DataFrame) -> DataFrame:
    """Annotations with title, depth and outline_key of their heading (`~` for none)."""
    headings = headings_at(annotated_pages(ann), ol)
    return spread_join(ann, headings, PAGE, "annot_idx")


def with_sort_y(ann: DataFrame) -> DataFrame:
    return ann.withColumn("sort_y", sort_y(F.col("kind"), F.col("y"), F.col("rects"),
                                           F.col("points")))


def line_of(sort_y: Column) -> Column:
    return sort_y - F.pmod(sort_y, F.lit(LINE))


def reading_order(assigned: DataFrame) -> DataFrame:
    """Add `rank`, the 1-based place in the section by page, height and position.

    A page is cut by height into lines, so that a page with very many heights is sorted line by line;
    annotations of the same height, as all carets and free texts are, are cut by position.
    """
    rows = stored(with_sort_y(assigned).drop("rects", "points")).withColumns(
        {"_line": line_of(F.col("sort_y")), "_part": annot_block()})
    levels = [["page_idx"], ["_line"], ["sort_y", "_part"]]
    return number_rows(rows, ["doc_id", "outline_key"], levels, ["annot_idx"], "rank").drop("_line", "_part")


def image_first_shown(ordered: DataFrame) -> DataFrame:
    """The annotations at which a section shows each of its images for the first time."""
    first = F.min(F.struct("page_idx", "sort_y", "annot_idx"))
    return (ordered.where(F.col("image_path").isNotNull())
            .groupBy("doc_id", "outline_key", "image_path").agg(first.alias("_first"))
            .select("doc_id", "outline_key", "image_path", "_first.page_idx", "_first.sort_y",
                    "_first.annot_idx"))


def with_image_shown(ordered: DataFrame) -> DataFrame:
    """Add show_image: false where the section has shown the same image before."""
    first = image_first_shown(ordered).select(*ANNOTATION, F.lit(True).alias("_first"))
    return (ordered.join(first, ANNOTATION, "left")
            .withColumn("show_image", F.coalesce("_first", F.lit(False))).drop("_first"))
