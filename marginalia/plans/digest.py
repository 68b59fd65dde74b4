"""The annotation digest: Markdown pieces of each document."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import file_stem
from marginalia.operators.blocks import ANNOTATION, PAGE, spread_join
from marginalia.operators.stored import stored
from marginalia.operators.crops import crops, image_dirs, with_images
from marginalia.operators.filters import filter_annotations
from marginalia.operators.names import file_stems, with_file_names
from marginalia.operators.passages import alone, highlight_text, in_bold, located
from marginalia.operators.render import annotation_block, document_head, section_head, summary_row
from marginalia.operators.sections import headings_at, with_image_shown, with_sort_y
from marginalia.operators.strokes import stroke_clusters
from marginalia.operators.summary import COUNTS, document_totals, page_counts, section_totals
from marginalia.plans.assembly import BLOCK, assemble


def annotation_digest(ann: DataFrame, ol: DataFrame, names: DataFrame, page_text: DataFrame,
                      glyphs: DataFrame, geometry: DataFrame | None = None,
                      page_range: str | None = None, colors: str | None = None) -> DataFrame:
    """Filter, read highlighted text from glyphs, crop pictures if geometry is given, digest.

    Pictures of a document go to a folder of its own, named after it.
    """
    if page_range is not None or colors is not None:
        ann = stored(filter_annotations(ann, page_range, colors))
    raw = stored(highlight_text(ann, glyphs))
    images = None
    if geometry is not None:
        images = stored(crops(ann, stroke_clusters(ann), geometry, image_dirs(names)))
    return digest(ann, ol, names, page_text, raw, images)


def digest(ann: DataFrame, ol: DataFrame, names: DataFrame, page_text: DataFrame | None = None,
           raw: DataFrame | None = None, images: DataFrame | None = None,
           rel_dir: str | None = None) -> DataFrame:
    """Digest of documents that have annotations, in pieces (doc_id, name, piece_no, markdown).

    Title and summary are piece 0. Sections follow in outline order, then annotations without a heading, with a
    piece for each page; a section's head stands on its first. Crowded pages and long summaries are cut
    further, see `assemble`. Columns that names have besides doc_id and name, as file_name, follow.
    """
    pages = stored(digest_pages(ann, ol))
    blocks, texts = _blocks(ann, pages, page_text, raw, images, rel_dir)
    placed = blocks.withColumns({"section": F.col("outline_key"), "part": F.lit(3), "outline_key": F.lit("")})
    return assemble(placed.select(*BLOCK).unionByName(_frame(pages, names)), texts, names)


def digest_pages(ann: DataFrame, ol: DataFrame) -> DataFrame:
    """Annotated pages with counts and heading."""
    return headings_at(page_counts(ann), ol)


def annotation_blocks(ann: DataFrame, pages: DataFrame, page_text: DataFrame | None = None,
                      raw: DataFrame | None = None, images: DataFrame | None = None,
                      rel_dir: str | None = None) -> DataFrame:
    """One row per annotation with its Markdown and the columns that place it."""
    blocks, texts = _blocks(ann, pages, page_text, raw, images, rel_dir)
    quote = F.concat(F.lit("> "), in_bold(F.col("text"), F.col("start"), F.col("size")), F.lit("\n"))
    return spread_join(blocks, texts, PAGE, "annot_idx").withColumn(
        "markdown", F.concat(F.coalesce(quote, F.lit("")), "markdown")).drop("start", "size", "bytes", "text")


def _blocks(ann: DataFrame, pages: DataFrame, page_text: DataFrame | None, raw: DataFrame | None,
            images: DataFrame | None, rel_dir: str | None) -> tuple[DataFrame, DataFrame]:
    """Annotations with Markdown, without the page text around highlights that are found there (start, size),
    and the text of such pages; `bytes` count both.
    """
    rows = with_sort_y(ann).drop("rects", "points")
    if images is not None:
        rows = rows.join(_shown_images(rows, pages, images, rel_dir), ANNOTATION, "left")
    rows = spread_join(rows, pages.select(*PAGE, "outline_key"), PAGE, "annot_idx")
    if raw is None:
        raw = ann.sparkSession.createDataFrame([], "doc_id long, page_idx int, annot_idx int, raw string")
    found = stored(located(raw, page_text))
    texts = found.where("is_first and text is not null").select(*PAGE, "text")
    places = found.select(*PAGE, F.octet_length("text").alias("_text_bytes"), F.inline("places"))
    markdown = annotation_block(images is not None)
    around = F.when(F.col("start").isNotNull(), F.col("_text_bytes") + len("> ****\n")).otherwise(0)
    blocks = (rows.join(places.withColumn("passage", alone(F.col("shown"))).drop("shown"), ANNOTATION, "left")
              .select(*ANNOTATION, "outline_key", "sort_y", "start", "size", "_text_bytes", markdown.alias("markdown"))
              .withColumn("bytes", F.octet_length("markdown") + around).drop("_text_bytes"))
    return blocks, texts


def _shown_images(rows: DataFrame, pages: DataFrame, images: DataFrame,
                  rel_dir: str | None) -> DataFrame:
    pictured = with_images(rows.select(*ANNOTATION, "sort_y"), images, rel_dir, "inner")
    placed = spread_join(pictured, pages.select(*PAGE, "outline_key"), PAGE, "annot_idx")
    return with_image_shown(placed).select(*ANNOTATION, "image_path", "show_image")


def _frame(pages: DataFrame, names: DataFrame) -> DataFrame:
    """Title, summary and section heads; the front lies before all sections, heads come before part 3."""
    front = {"section": F.lit(""), "page_idx": F.lit(-1)}
    totals = document_totals(pages).join(names.select("doc_id", "name"), "doc_id", "left")
    base_name = F.coalesce(F.substring_index("name", "/", -1), F.lit(""))
    head = document_head(base_name, F.col("annotations"), F.col("pages"))
    ends = totals.select("doc_id", F.lit("").alias("outline_key"), F.explode(F.array(
        F.struct(F.lit(0).alias("part"), head.alias("markdown")),
        F.struct(F.lit(2).alias("part"), F.lit("\n").alias("markdown")))).alias("_b"))
    sections = section_totals(pages, F.min("page_idx").alias("page_idx"))
    row = summary_row(F.col("title"), [F.col(c) for c in COUNTS])
    rows = sections.select("doc_id", "outline_key", F.lit(1).alias("part"), row.alias("markdown"))
    heads = sections.select(
        "doc_id", F.col("outline_key").alias("section"), "page_idx", F.lit(2).alias("part"), F.lit("").alias("outline_key"),
        section_head(F.col("title"), F.col("depth")).alias("markdown"))
    none = {"sort_y": F.lit(0.0), "annot_idx": F.lit(0), "start": F.lit(None).cast("int"), "size": F.lit(None).cast("int"),
            "bytes": F.octet_length("markdown")}
    blocks = (ends.select("doc_id", "outline_key", "_b.*").unionByName(rows).withColumns(front)
              .unionByName(heads))
    return blocks.withColumns(none).select(*BLOCK)


def digest_files(texts: DataFrame, suffix: str = "-annotations.md", names: DataFrame | None = None) -> DataFrame:
    """Add file_name, the document's name with its extension replaced; with the table of names, a different one for
    each document.
    """
    if names is not None:
        return with_file_names(texts, file_stems(names), suffix)
    return texts.withColumn("file_name", F.concat(file_stem(F.col("name")), F.lit(suffix)))
