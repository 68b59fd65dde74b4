"""Input tables. A document is a key, so one job covers a whole library."""

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.FloatType()) for n in ("x", "y", "w", "h")])
POINT = T.StructType([T.StructField(n, T.FloatType()) for n in ("x", "y")])

# kind: highlight, note, rect, freehand, caret or free_text; anything else counts as "other". Underline, strikeout
# and squiggly become highlights where the table is read.
# page_idx is 0-based; annot_idx is the position in the page's list.
ANNOTATIONS = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("page_idx", T.IntegerType(), False),
    T.StructField("annot_idx", T.IntegerType(), False),
    T.StructField("kind", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("contents", T.StringType()),
    T.StructField("note_text", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("x", T.FloatType()),
    T.StructField("y", T.FloatType()),
    T.StructField("w", T.FloatType()),
    T.StructField("h", T.FloatType()),
    T.StructField("rects", T.ArrayType(BOX)),
    T.StructField("points", T.ArrayType(POINT)),
])

# sibling_ord: the entry's place among its siblings, not negative and not repeated there.
OUTLINE_ENTRIES = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("parent_id", T.LongType()),
    T.StructField("sibling_ord", T.LongType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("page_idx", T.IntegerType()),
])

PAGE_TEXT = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("page_idx", T.IntegerType(), False),
    T.StructField("text", T.StringType()),
])

GLYPHS = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("page_idx", T.IntegerType(), False),
    T.StructField("glyph_idx", T.IntegerType(), False),
    T.StructField("ch", T.StringType()),
    T.StructField("x0", T.FloatType()),
    T.StructField("y0", T.FloatType()),
    T.StructField("x1", T.FloatType()),
    T.StructField("y1", T.FloatType()),
])

# Size in pixels of the page picture the crops are cut from.
PAGE_GEOMETRY = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("page_idx", T.IntegerType(), False),
    T.StructField("bmp_w", T.IntegerType()),
    T.StructField("bmp_h", T.IntegerType()),
])

DOCUMENT_NAMES = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("name", T.StringType()),
])
