"""Every operator as a query over the derived library."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import (
    clean_text, effective_contents, is_blank, normalize_color)
from marginalia.operators import crops as crop_ops
from marginalia.operators.blocks import ANNOTATION, PAGE
from marginalia.operators.filters import filter_annotations, filter_colors, filter_pages, filter_report
from marginalia.operators.outline import dedup_outline, flatten_outline
from marginalia.operators.passages import annotated_page_text, highlight_text, in_pages
from marginalia.operators.positions import position_maps
from marginalia.operators.render import annotation_label, heading_level
from marginalia.operators.sections import assign_headings, image_first_shown, reading_order, with_sort_y
from marginalia.operators.stored import stored
from marginalia.operators.strokes import cluster_bounds, stroke_boxes, stroke_clusters, stroke_links
from marginalia.operators.summary import COUNTS, document_totals, page_counts, section_summary
from marginalia.plans.digest import annotation_blocks, annotation_digest, digest, digest_files, digest_pages
from marginalia.plans.export import corpus_export
from marginalia.sources.corpus import Corpus
from marginalia.sources.files import annotation_records, annotations_of, errors_of, outline_of

PAGE_RANGE = "1,3,5-6,8-,4-2"
COLORS = "#ff0, 0000FF"
IMAGE_DIR = "out/images"
LONGEST_GAP = 120.0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable:
    def register(build: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(Corpus(spark, folder))
        return build
    return register


def _outline(c: Corpus) -> DataFrame:
    return flatten_outline(stored(c.outline_entries()))


def _images(c: Corpus, ann: DataFrame) -> DataFrame:
    return crop_ops.crops(ann, stroke_clusters(ann), c.geometry(), IMAGE_DIR)


@query("annotation_scan")
def _annotation_scan(c):
    """Annotations as they come in, boxes and points counted."""
    return c.annotations().select(
        *ANNOTATION, "event_id", "kind", "color", "contents", "note_text", "author", "state", "x", "y",
        "w", "h", F.coalesce(F.array_size("rects"), F.lit(0)).alias("n_rects"),
        F.coalesce(F.array_size("points"), F.lit(0)).alias("n_points"))


@query("annotation_files")
def _annotation_files(c):
    """Annotations out of nested files."""
    return annotations_of(annotation_records(c.annotation_files())).select(
        *ANNOTATION, "kind", "color", "contents", "note_text", "author", "state", "x", "y", "w", "h",
        F.coalesce(F.array_size("rects"), F.lit(0)).alias("n_rects"), F.coalesce(F.array_size("points"), F.lit(0)).alias("n_points"))


@query("annotation_file_errors")
def _annotation_file_errors(c):
    """What cannot be read of good and broken files."""
    files = c.annotation_files().unionByName(c.broken_files())
    return errors_of(annotation_records(files)).select(*ANNOTATION, "reason")


@query("outline_files")
def _outline_files(c):
    """Outlines out of nested files."""
    return outline_of(c.outline_files())


@query("outline_preorder")
def _outline_preorder(c):
    return _outline(c).withColumn("level", heading_level(F.col("depth")))


@query("outline_dedup")
def _outline_dedup(c):
    return dedup_outline(_outline(c))


@query("heading_assignment")
def _heading_assignment(c):
    return assign_headings(stored(c.annotations()), _outline(c)).select(
        *ANNOTATION, "event_id", "title", "depth", "outline_key")


@query("reading_order")
def _reading_order_in_sections(c):
    return reading_order(assign_headings(stored(c.annotations()), _outline(c))).select(
        "doc_id", "outline_key", "rank", "page_idx", "sort_y", "annot_idx", "event_id")


@query("section_summary")
def _section_counts(c):
    return section_summary(c.marks(), _outline(c)).select(
        "doc_id", "outline_key", "title", "depth", *COUNTS)


@query("document_totals")
def _document_counts(c):
    return document_totals(page_counts(c.marks()))


@query("page_range_filter")
def _page_range_filter(c):
    return filter_pages(c.annotations(), PAGE_RANGE).select(*ANNOTATION, "event_id", "kind")


@query("color_normalize")
def _color_normalize(c):
    return c.marks().select("event_id", "color",
                                  normalize_color(F.col("color")).alias("normal_color"))


@query("color_filter")
def _color_filter(c):
    return filter_colors(c.annotations(), COLORS).select(*ANNOTATION, "event_id", "color")


@query("reindexed_annotations")
def _page_and_color_filter(c):
    return filter_annotations(c.annotations(), PAGE_RANGE, COLORS).select(*ANNOTATION, "event_id")


@query("filter_report")
def _page_filter_report(c):
    return filter_report(c.marks(), c.page_entries(), PAGE_RANGE)


@query("color_filter_report")
def _color_filter_report(c):
    return filter_report(c.marks(), c.page_entries(), PAGE_RANGE, COLORS)


@query("annotated_page_text")
def _annotated_pages_text(c):
    return annotated_page_text(c.page_text(), c.marks())


@query("drawable_pages")
def _drawable_pages(c):
    return crop_ops.drawable_pages(c.marks())


@query("clean_text")
def _cleaned_documents(c):
    noisy = F.expr("replace(replace(text, 'th', concat('t', char(173), 'h')), ' ', ' \\t')")
    return c.documents.select("doc_id", clean_text(noisy).alias("cleaned"))


@query("highlight_in_context")
def _highlight_in_context(c):
    raw = c.highlight_raw(stored(c.annotations()))
    return in_pages(raw, c.page_text()).select(*ANNOTATION, "passage")


@query("position_map")
def _position_map(c):
    """Runs of the map from cleaned page text back to the page."""
    maps = position_maps(c.page_text())
    return maps.select(*PAGE, F.inline("runs"))


@query("highlight_text_from_glyphs")
def _highlight_text_from_glyphs(c):
    ann = stored(c.annotations())
    marked = ann.where("kind = 'highlight'")
    return highlight_text(ann, c.glyphs(annotated_page_text(c.page_text().repartition(*PAGE), marked)))


@query("annotation_labels")
def _annotation_labels(c):
    return c.marks().select("event_id", annotation_label().alias("label"))


@query("markup_kinds")
def _markup_kinds(c):
    """Kinds as they come in and as they are shown."""
    return c.marks().select("event_id", "raw_kind", "kind")


@query("effective_note_text")
def _note_texts(c):
    note = effective_contents(F.col("contents"), F.col("note_text"))
    return c.marks().where("kind = 'note'").select("event_id", note.alias("note"))


@query("blank_text")
def _blank_comments(c):
    return c.marks().select("event_id", is_blank(F.col("contents")).alias("no_comment"),
                                  is_blank(F.col("author")).alias("no_author"))


@query("stroke_bounds")
def _stroke_bounding_boxes(c):
    return stroke_boxes(c.annotations())


@query("stroke_clusters")
def _stroke_cluster_members(c):
    return stroke_clusters(stored(c.annotations())).select(*ANNOTATION, "cluster_idx")


@query("stroke_links")
def _stroke_links(c):
    """Links for every distance up to LONGEST_GAP points."""
    return stroke_links(stored(c.annotations()), LONGEST_GAP)


@query("cluster_bounds")
def _stroke_cluster_bounds(c):
    return cluster_bounds(stroke_clusters(stored(c.annotations())))


@query("pixel_boxes")
def _crop_boxes(c):
    ann = stored(c.annotations())
    return crop_ops.pixel_boxes(ann, stroke_clusters(ann), c.geometry())


@query("crop_numbering")
def _crop_numbers(c):
    ann = stored(c.annotations())
    boxes = crop_ops.pixel_boxes(ann, stroke_clusters(ann), c.geometry())
    return crop_ops.number_crops(boxes, IMAGE_DIR)


@query("crops")
def _image_map(c):
    return _images(c, stored(c.annotations()))


@query("annotation_images")
def _annotation_images(c):
    """Every annotation, with the picture it shows if it has one."""
    ann = stored(c.annotations())
    return crop_ops.with_images(ann.select(*ANNOTATION, "kind"), _images(c, ann))


@query("image_first_occurrence")
def _first_image_occurrences(c):
    ann = stored(c.annotations())
    pictured = crop_ops.with_images(with_sort_y(ann), stored(_images(c, ann)), how="inner")
    return image_first_shown(assign_headings(pictured, _outline(c)))


@query("annotation_blocks")
def _annotation_markdown(c):
    ann, page_text = stored(c.annotations()), c.page_text()
    pages = stored(digest_pages(ann, _outline(c)))
    images = stored(_images(c, ann))
    return annotation_blocks(ann, pages, page_text, c.highlight_raw(ann), images).select(
        *ANNOTATION, "markdown")


@query("annotation_digest")
def _document_digest(c):
    return _digest_of(c, c.names())


def _digest_of(c: Corpus, names: DataFrame) -> DataFrame:
    ann = stored(c.annotations())
    raw = stored(c.highlight_raw(ann))
    return digest(ann, _outline(c), names, c.page_text(), raw)


@query("filtered_digest_with_images")
def _filtered_digest_with_images(c):
    """Filters, glyph text and crops, each on the annotations that are left."""
    ann, page_text = stored(c.annotations()), c.page_text()
    marked = filter_annotations(ann, PAGE_RANGE).where("kind = 'highlight'")
    glyphs = c.glyphs(annotated_page_text(page_text.repartition(*PAGE), marked))
    return annotation_digest(ann, _outline(c), c.names(), page_text, glyphs, c.geometry(),
                             PAGE_RANGE, COLORS)


@query("digest_files")
def _digest_file_rows(c):
    return _digest_of(c, digest_files(c.names(), names=c.names()))


@query("corpus_export")
def _whole_document_export(c):
    ann = stored(c.annotations())
    names = digest_files(c.names(), "-export.md", c.names())
    return corpus_export(c.page_text(), ann, names, c.highlight_raw(ann))


@query("page_range_export")
def _page_range_export(c):
    ann = stored(c.annotations())
    return corpus_export(c.page_text(), ann, c.names(), c.highlight_raw(ann), PAGE_RANGE)
