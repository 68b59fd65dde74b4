"""Whole documents as Markdown, with their annotations folded in."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import clean_text, is_blank
from marginalia.operators.blocks import ANNOTATION, PAGE, number_rows, page_block
from marginalia.operators.filters import filter_pages
from marginalia.operators.passages import alone
from marginalia.operators.render import annotation_block
from marginalia.operators.sections import with_sort_y
from marginalia.operators.stored import stored
from marginalia.plans.assembly import ORDER, PIECE_BYTES, cut_by_bytes, more_of, named

PAGE_BREAK = "---\n\n"


def corpus_export(page_text: DataFrame, ann: DataFrame, names: DataFrame,
                  raw: DataFrame | None = None,
                  page_range: str | None = None) -> DataFrame:
    """Text of each page, then its annotations in reading order; breaks between pages.

    A page is a piece. Where text and annotations are more than a piece should hold, the text is one piece and
    the annotations are cut into more. They are put together before they meet the text, which is shuffled once.
    Columns that names have besides doc_id and name follow.
    """
    if page_range is not None:
        page_text, ann = filter_pages(page_text, page_range), filter_pages(ann, page_range)
    page_text = page_text.where(F.length("text") > 0).select(*PAGE, "text")
    blocks = stored(_blocks(ann, raw))
    sizes = (page_text.select(*PAGE, F.octet_length("text").alias("text_bytes"), F.lit(0).alias("bytes"))
             .unionByName(blocks.select(*PAGE, F.lit(0).alias("text_bytes"), "bytes"))
             .groupBy(*PAGE).agg(F.max("text_bytes").alias("text_bytes"), F.sum("bytes").alias("bytes")))
    is_crowded = (F.col("bytes") > 0) & (F.col("text_bytes") + F.col("bytes") > PIECE_BYTES // 2)
    sizes = stored(sizes.withColumn("is_crowded", is_crowded))
    crowded = sizes.where("is_crowded").select(*PAGE)
    cut = cut_by_bytes(blocks.join(crowded, PAGE, "left_semi"), PAGE).withColumn("cut", F.col("cut") + 1)
    text_alone = sizes.where("is_crowded = false or text_bytes > 0").select(*PAGE, F.lit(0).cast("long").alias("cut"))
    pieces = text_alone.unionByName(cut.select(*PAGE, "cut").distinct())
    is_first = F.col("cut") == F.min("cut").over(Window.partitionBy(*PAGE))
    pieces = pieces.withColumns({"_first": is_first, "_pages": page_block()})
    numbered = named(number_rows(pieces, ["doc_id"], [["_pages"]], ["page_idx", "cut"], "_place"), names)
    joined = F.expr(f"listagg(markdown, '') within group (order by {', '.join(ORDER)})")
    folded = (blocks.join(crowded, PAGE, "left_anti").withColumn("cut", F.lit(0).cast("long")).unionByName(cut)
              .where("bytes > 0").groupBy(*PAGE, "cut").agg(joined.alias("markdown")))
    texts = page_text.withColumn("cut", F.lit(0).cast("long"))
    breaks = F.when((F.col("_place") > 1) & F.col("_first"), PAGE_BREAK).otherwise("")
    body = F.coalesce(F.concat("text", F.lit("\n\n")), F.lit(""))
    return (numbered.join(texts, [*PAGE, "cut"], "left").join(folded, [*PAGE, "cut"], "left")
            .select("doc_id", "name", (F.col("_place") - 1).alias("piece_no"),
                    F.concat(breaks, body, F.coalesce("markdown", F.lit(""))).alias("markdown"), *more_of(names)))


def _blocks(ann: DataFrame, raw: DataFrame | None) -> DataFrame:
    """Annotations with Markdown, placed by ORDER."""
    rows = with_sort_y(ann)
    if raw is None:
        rows = rows.withColumn("raw", F.lit(None).cast("string"))
    else:
        rows = rows.join(raw.select(*ANNOTATION, "raw"), ANNOTATION, "left")
    shown = clean_text(F.col("raw"))
    return (rows.withColumn("passage", F.when(~is_blank(shown), alone(shown)))
            .select(*PAGE, F.lit(0).alias("part"), F.lit("").alias("outline_key"), "sort_y", "annot_idx", annotation_block().alias("markdown"))
            .withColumn("bytes", F.octet_length("markdown")))
