"""Highlighted text: read from glyph boxes, then shown in bold inside its page."""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.geometry import cell, cell_of, cells_between
from marginalia.functions.text import case_fold, clean_text, is_blank, passage_pattern
from marginalia.operators.blocks import ANNOTATION, PAGE, block_of
from marginalia.operators.positions import place_passages
from marginalia.operators.sections import annotated_pages
from marginalia.operators.stored import stored

# Side of the smallest squares, in points, that bring glyphs and highlight boxes together; each level above has
# squares twice as large. A box lies on the level whose squares are at least as large as it.
CELL = 36.0
# Pages of at most so many boxes compare each with all of their glyphs; only larger ones need the grid.
FEW_BOXES = 1024
# Highlights of a page, by position, that meet its glyphs in one task.
BOXES_PER_BLOCK = 16384
# Highlights of a page, by position, that are looked up in it together.
HIGHLIGHTS_PER_BLOCK = 512


def annotated_page_text(page_text: DataFrame, ann: DataFrame) -> DataFrame:
    """Text of the pages that carry annotations; empty text counts as none."""
    return page_text.where(F.length("text") > 0).join(annotated_pages(ann), PAGE, "left_semi")


def highlight_text(ann: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Text under each highlight: `raw` by (doc_id, page_idx, annot_idx).

    A glyph belongs to a box that holds its centre. Glyphs come in page order, boxes in list
    order with a space between; boxes without text are left out, highlights without text too.
    """
    highlights = ann.where((F.col("kind") == "highlight") & (F.array_size("rects") > 0))
    centres = glyphs.select(*PAGE, "glyph_idx", "ch", _middle("x0", "x1").alias("cx"),
                            _middle("y0", "y1").alias("cy"))
    boxes = (highlights.select(*ANNOTATION, F.posexplode("rects").alias("rect_idx", "r"))
             .select(*ANNOTATION, "rect_idx", F.col("r.x").alias("left"), F.col("r.y").alias("top"),
                     (F.col("r.x") + F.col("r.w")).alias("right"),
                     (F.col("r.y") + F.col("r.h")).alias("bottom"))
             .where("left <= right and top <= bottom and annot_idx is not null"))
    inside = _meet(boxes, centres)
    pieces = (inside.groupBy(*ANNOTATION, "rect_idx")
              .agg(F.expr("listagg(ch, '') within group (order by glyph_idx)").alias("piece"))
              .where(F.length("piece") > 0))
    return pieces.groupBy(*ANNOTATION).agg(
        F.expr("listagg(piece, ' ') within group (order by rect_idx)").alias("raw"))


def _middle(low: str, high: str) -> Column:
    return (F.col(low).cast("double") + F.col(high).cast("double")) / 2


def _meet(boxes: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs of box and glyph centre inside it.

    Boxes of a page are few, so they are held in a hash table and its glyphs go past them as they come: glyphs are
    neither sorted nor, where they come by page, shuffled. Pages of more than FEW_BOXES boxes, which are few, take the grid.
    """
    crowded = stored(boxes.groupBy(*PAGE).agg(F.count("*").alias("n")).where(F.col("n") > FEW_BOXES).select(*PAGE))
    if crowded.isEmpty():
        return _meet_on_pages(boxes, centres)
    crowded = F.broadcast(crowded)
    return _meet_on_pages(boxes.join(crowded, PAGE, "left_anti"), centres).unionByName(
        _meet_in_cells(boxes.join(crowded, PAGE, "left_semi"), centres.join(crowded, PAGE, "left_semi")))


def _meet_on_pages(boxes: DataFrame, centres: DataFrame) -> DataFrame:
    return _inside(centres.join(boxes.hint("shuffle_hash"), PAGE))


def _meet_in_cells(boxes: DataFrame, centres: DataFrame) -> DataFrame:
    """Both meet in the cells of a grid: a box in at most four of its own level, a glyph in one of each level that
    boxes of its page have. Glyphs are copied to each block of annotations on their page, which spreads a page
    with very many highlights.
    """
    size = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top")).cast("double")
    side = F.lit(CELL) * F.pow(F.lit(2.0), F.col("_level"))
    boxes = (boxes.withColumn("_block", block_of(F.col("annot_idx"), BOXES_PER_BLOCK))
             .withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size / CELL, F.lit(1.0)))).cast("int"))))
    wanted = boxes.select(*PAGE, "_block", "_level").distinct()
    boxes = (boxes.withColumn("_col", F.explode(cells_between(cell_of(F.col("left"), side), cell_of(F.col("right"), side))))
             .withColumn("_row", F.explode(cells_between(cell_of(F.col("top"), side), cell_of(F.col("bottom"), side))))
             .withColumn("_cell", cell(F.col("_col"), F.col("_row"))).drop("_col", "_row"))
    centres = (centres.join(wanted, PAGE)
               .withColumn("_cell", cell(cell_of(F.col("cx"), side), cell_of(F.col("cy"), side))))
    return _inside(boxes.join(centres, [*PAGE, "_block", "_level", "_cell"]))


def _inside(met: DataFrame) -> DataFrame:
    return met.where("cx between left and right and cy between top and bottom").select(
        *ANNOTATION, "rect_idx", "glyph_idx", "ch")


def located(raw: DataFrame, page_text: DataFrame | None) -> DataFrame:
    """Where highlighted text (`raw` by annotation) stands in its page, in blocks of a page's highlights:
    (doc_id, page_idx, text, is_first, places), where places are (annot_idx, start, size, shown).

    The cleaned highlight is looked up in the page text without regard to case, and failing that, as if the page
    text were cleaned too. start counts from 1. Where it is found nowhere or there is no page text, start
    is null and `shown` the highlight by itself, null if it is blank. A block reads its page once. Each
    block has the text of its page; is_first is true for one block of each page.
    """
    shown = F.when(~is_blank(clean_text(F.col("raw"))), clean_text(F.col("raw")))
    rows = raw.select(*ANNOTATION, shown.alias("shown"), block_of(F.col("annot_idx"), HIGHLIGHTS_PER_BLOCK).alias("block"))
    wanted = F.struct("annot_idx", "shown", case_fold(F.col("shown")).alias("needle"))
    blocks = rows.groupBy(*PAGE, "block").agg(F.collect_list(wanted).alias("wanted"))
    first = F.min("block").over(Window.partitionBy(*PAGE))
    blocks = blocks.withColumn("is_first", F.col("block") == first).drop("block")
    if page_text is None:
        blocks = blocks.withColumn("text", F.lit(None).cast("string"))
    else:
        blocks = blocks.join(page_text.where(F.length("text") > 0).select(*PAGE, "text"), PAGE, "left")
    return (blocks.select(*PAGE, "is_first", "text", case_fold(F.col("text")).alias("folded"), "wanted")
            .mapInArrow(_locate, LOCATED))


LOCATED = ("doc_id long, page_idx int, is_first boolean, text string, "
           "places array<struct<annot_idx int, start int, size int, shown string>>")


def _locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = pa.list_(pa.struct([("annot_idx", pa.int32()), ("start", pa.int32()), ("size", pa.int32()), ("shown", pa.string())]))
    for batch in batches:
        rows = []
        for folded, wanted in zip(batch["folded"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
            found = {} if folded is None else place_passages(folded, {w["needle"] for w in wanted if w["needle"]})
            row = []
            for w in wanted:
                start, size = found.get(w["needle"], (None, None))
                row.append({"annot_idx": w["annot_idx"], "start": None if start is None else start + 1, "size": size,
                            "shown": w["shown"] if start is None else None})
            rows.append(row)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*PAGE, "is_first", "text")), pa.array(rows, places)],
                                         [*PAGE, "is_first", "text", "places"])


def in_bold(text: Column, start: Column, size: Column) -> Column:
    """The text with a stretch of it in bold."""
    end = start + size
    return F.concat(F.substring(text, F.lit(1), start - 1), F.lit("**"), F.substring(text, start, size), F.lit("**"),
                    F.substring(text, end, F.length(text)))


def alone(shown: Column) -> Column:
    return F.concat(F.lit("**"), shown, F.lit("**"))


def in_pages(raw: DataFrame, page_text: DataFrame) -> DataFrame:
    """`passage` by annotation: its page with the highlighted text in bold, or the highlight alone."""
    rows = located(raw, page_text).select(*PAGE, "text", F.inline("places"))
    passage = F.coalesce(in_bold(F.col("text"), F.col("start"), F.col("size")), alone(F.col("shown")))
    return rows.select(*ANNOTATION, passage.alias("passage"))


def with_passage(rows: DataFrame, text: str = "text", raw: str = "raw") -> DataFrame:
    """Add `passage`: the page text with the highlighted text in bold.

    The cleaned highlight is looked up in the page text without regard to case. Failing that,
    it is looked up as if the page text were cleaned too, and the matching stretch of the
    untouched text is marked. Failing that, or without page text, the highlight stands alone.
    Only the first occurrence is marked. Null when there is no highlighted text. This is the form for rows that
    have both texts; `in_pages` brings them together, with many highlights on a page.
    """
    found = F.coalesce(F.position(F.col("_needle"), F.col("_folded")), F.lit(0))
    rows = (rows.withColumn("_shown", clean_text(F.col(raw)))
            .withColumn("_shown", F.when(~is_blank(F.col("_shown")), F.col("_shown")))
            .withColumn("_needle", case_fold(F.col("_shown")))
            .withColumn("_folded", F.when(F.col("_shown").isNotNull(), case_fold(F.col(text))))
            .withColumn("_at", found))
    loose = F.when((F.col("_at") == 0) & F.col("_folded").isNotNull(),
                   F.regexp_substr(F.col("_folded"), passage_pattern(F.col("_needle"))))
    rows = (rows.withColumn("_loose", loose)
            .withColumn("_start", F.when(F.col("_at") > 0, F.col("_at"))
                        .otherwise(F.position(F.col("_loose"), F.col("_folded"))))
            .withColumn("_size", F.length(F.coalesce("_loose", "_needle"))))
    in_context = in_bold(F.col(text), F.col("_start"), F.col("_size"))
    return (rows.withColumn("passage", F.coalesce(in_context, alone(F.col("_shown"))))
            .drop("_shown", "_needle", "_folded", "_at", "_loose", "_start", "_size"))
