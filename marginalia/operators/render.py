"""Markdown blocks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import clean_text, effective_contents, is_blank, label

# Wording of the digest.
TITLE = "# Annotations: "
SUMMARY_TITLE = "## Summary"
TABLE_HEAD = ("| Section | Highlights | Notes | Rectangles | Freehand | Other |\n"
              "|---------|-----------|-------|------------|----------|-------|\n")
OTHER_ROW = "*(Other)*"
OTHER_TITLE = "## Other Annotations"
NO_DRAWING = "> *[Freehand drawing — use `--images` to include a screenshot]*"
KIND_NAMES = {"highlight": "highlight", "note": "note", "rect": "rectangle",
              "freehand": "freehand", "caret": "caret", "free_text": "free text"}
TOP_LEVEL, LOWEST_LEVEL = 2, 4


def heading_level(depth: Column) -> Column:
    return F.least(depth + TOP_LEVEL, F.lit(LOWEST_LEVEL))


def annotation_label() -> Column:
    """Page and kind of an annotation; notes also name review state and author. Null for kinds
    that are not shown."""
    kind = F.col("kind")
    name = F.create_map(*(F.lit(part) for pair in KIND_NAMES.items() for part in pair))[kind]
    is_note = kind == "note"
    return F.when(name.isNotNull(), label(F.col("page_idx"), name,
                                          F.when(is_note, F.col("state")),
                                          F.when(is_note, F.col("author"))))


def annotation_block(images: bool = False) -> Column:
    """Markdown of one annotation; empty for unknown kinds.

    Reads kind, page_idx, contents, note_text, state, author and passage, and with images also
    image_path and show_image.
    """
    kind, contents = F.col("kind"), F.col("contents")
    free_text = clean_text(contents)
    comment = _if(~is_blank(contents), F.lit("> **Comment:** "), contents, F.lit("\n"))
    highlight = F.concat(_if(F.col("passage").isNotNull(), F.lit("> "), F.col("passage"), F.lit("\n")),
                         _if(~is_blank(contents), F.lit(">\n")), comment, F.lit(">\n"))
    note = F.concat(F.lit("> **Note:** "),
                    F.coalesce(effective_contents(contents, F.col("note_text")), F.lit("")),
                    F.lit("\n>\n"))
    rect, freehand = F.lit(">\n"), F.lit(NO_DRAWING + "\n>\n")
    if images:
        has_image, show_image = F.col("image_path").isNotNull(), F.col("show_image")
        rect = F.concat(_if(has_image, *_picture("Rectangle")), rect)
        freehand = (F.when(has_image & show_image, F.concat(*_picture("Freehand")))
                    .when(has_image, "").otherwise(freehand))
    caret = F.concat(comment, _if(~is_blank(contents), F.lit(">\n")))
    text = _if(~is_blank(free_text), F.lit("> **Free text:** "), free_text, F.lit("\n>\n"))
    body = (F.when(kind == "highlight", highlight).when(kind == "note", note)
            .when(kind == "rect", rect).when(kind == "freehand", freehand)
            .when(kind == "caret", caret).when(kind == "free_text", text))
    block = F.concat(body, F.lit("> "), annotation_label(), F.lit("\n\n"))
    return F.coalesce(block, F.lit(""))


def _picture(name: str) -> list[Column]:
    return [F.lit(f"![{name} annotation, p. "), (F.col("page_idx") + 1).cast("string"), F.lit("]("),
            F.col("image_path"), F.lit(")\n\n")]


def _if(condition: Column, *parts: Column) -> Column:
    return F.when(condition, F.concat(*parts)).otherwise(F.lit(""))


def document_head(name: Column, annotations: Column, pages: Column) -> Column:
    """Title, count line and head of the summary table."""
    return F.concat(F.lit(TITLE), name, F.lit(f"\n\n{SUMMARY_TITLE}\n\n**"),
                    annotations.cast("string"), F.lit(" annotations** across **"),
                    pages.cast("string"), F.lit(" pages**\n\n" + TABLE_HEAD))


def summary_row(title: Column, counts: list[Column]) -> Column:
    cells = [F.coalesce(title, F.lit(OTHER_ROW)), *(c.cast("string") for c in counts)]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |\n"))


def section_head(title: Column, depth: Column) -> Column:
    named = F.concat(F.repeat(F.lit("#"), heading_level(depth)), F.lit(" "), title)
    return F.concat(F.coalesce(named, F.lit(OTHER_TITLE)), F.lit("\n\n"))
