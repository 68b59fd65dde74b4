"""Page, colour and kind filters on the annotation table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import normalize_color, page_in_range, parse_colors
from marginalia.operators.blocks import PAGE, annot_block, number_rows


def filter_pages(rows: DataFrame, page_range: str) -> DataFrame:
    """Rows whose page lies in a 1-based range such as `"1,3,5-10,12-"`."""
    return rows.where(page_in_range(F.col("page_idx"), page_range))


def filter_colors(ann: DataFrame, colors: str) -> DataFrame:
    """Annotations of the given colours, numbered afresh within their pages.

    The filter comes before the numbering: positions count the annotations that are left.
    """
    kept = ann.where(normalize_color(F.col("color")).isin(parse_colors(colors)))
    return reindex(kept)


def reindex(ann: DataFrame) -> DataFrame:
    """Set annot_idx to the 0-based position among the page's remaining annotations."""
    numbered = number_rows(ann.withColumn("_block", annot_block()), PAGE, [["_block"]],
                           ["annot_idx"], "_number")
    return (numbered.withColumn("annot_idx", (F.col("_number") - 1).cast("int"))
            .select(*ann.columns))


def filter_annotations(ann: DataFrame, page_range: str | None = None,
                       colors: str | None = None) -> DataFrame:
    if page_range is not None:
        ann = filter_pages(ann, page_range)
    return ann if colors is None else filter_colors(ann, colors)


def filter_report(ann: DataFrame, page_entries: DataFrame, page_range: str | None = None,
                  colors: str | None = None) -> DataFrame:
    """Per document, the annotations and page entries that pass the filters.

    The page filter keeps entries without annotations, the colour filter drops them.
    """
    if page_range is not None:
        ann = filter_pages(ann, page_range)
        page_entries = filter_pages(page_entries, page_range)
    if colors is not None:
        ann = ann.where(normalize_color(F.col("color")).isin(parse_colors(colors)))
    sizes = ann.groupBy(*PAGE).agg(F.count("*").alias("n"))
    pages = sizes
    if colors is None:
        empty = page_entries.select(*PAGE, F.lit(0).cast("bigint").alias("n"))
        pages = sizes.unionByName(empty).groupBy(*PAGE).agg(F.max("n").alias("n"))
    return pages.groupBy("doc_id").agg(F.sum("n").alias("annotations"),
                                       F.count("*").alias("pages"))
