"""Counts per page, section and document."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.blocks import PAGE
from marginalia.operators.sections import headings_at

COUNTED = {"highlights": "highlight", "notes": "note", "rectangles": "rect",
           "freehand": "freehand"}
COUNTS = [*COUNTED, "other"]


def page_counts(ann: DataFrame) -> DataFrame:
    """Annotations by kind for every annotated page."""
    kind = F.coalesce("kind", F.lit(""))
    return ann.groupBy(*PAGE).agg(
        F.count("*").alias("annotations"),
        *(F.count_if(kind == value).alias(name) for name, value in COUNTED.items()),
        F.count_if(~kind.isin(*COUNTED.values())).alias("other"))


def document_totals(pages: DataFrame) -> DataFrame:
    """Annotations and annotated pages per document, from page counts."""
    return pages.groupBy("doc_id").agg(F.sum("annotations").alias("annotations"), F.count("*").alias("pages"))


def section_summary(ann: DataFrame, ol: DataFrame) -> DataFrame:
    """Annotations by kind for every section that has any; `outline_key` `~` is "(Other)".

    A page lies in one section, so counts are taken per page before headings are looked up.
    """
    return section_totals(headings_at(page_counts(ann), ol))


def section_totals(pages: DataFrame, *more: Column) -> DataFrame:
    return (pages.groupBy("doc_id", "outline_key", "title", "depth")
            .agg(*(F.sum(c).alias(c) for c in COUNTS), *more))
