"""Putting ordered blocks together to documents in pieces.

Every document has the same form: rows (doc_id, name, piece_no, markdown), to be read by piece_no. A piece holds
blocks of one place: the front of a digest, a page of a section, a page of an export. A place of more than
half of PIECE_BYTES is cut by the running sum of its bytes, so no piece is larger than PIECE_BYTES but a
single block.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.blocks import PAGE, annot_block, block_of, number_rows, page_block, running_total
from marginalia.operators.passages import in_bold
from marginalia.operators.sections import line_of
from marginalia.operators.stored import stored

PIECE_BYTES = 1 << 20
PLACE = ["doc_id", "section", "page_idx"]
ORDER = ["part", "outline_key", "sort_y", "annot_idx"]
BLOCK = [*PLACE, *ORDER, "start", "size", "bytes", "markdown"]


def assemble(blocks: DataFrame, texts: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name, piece_no, markdown) from blocks with the columns of BLOCK, in the order of PLACE and ORDER, and
    further columns of names.

    A block with a start is a highlight in its page: the page's text, a row of `texts` (doc_id, page_idx, text),
    is put in front of its Markdown with the stretch in bold. `bytes` count it, so the text meets a piece once,
    after the cut, and not each of its blocks.
    """
    blocks = stored(blocks)
    sizes = blocks.groupBy(*PLACE).agg(F.sum("bytes").alias("total"))
    crowded = sizes.where(F.col("total") > PIECE_BYTES // 2).select(*PLACE)
    cut = cut_by_bytes(blocks.join(crowded, PLACE, "left_semi"), PLACE)
    calm = sizes.join(crowded, PLACE, "left_anti").select(*PLACE, F.lit(0).cast("long").alias("cut"))
    pieces = calm.unionByName(cut.select(*PLACE, "cut").distinct()).withColumn("_pages", page_block())
    numbered = number_rows(pieces, ["doc_id"], [["section"], ["_pages"]], ["page_idx", "cut"], "piece_no").drop("_pages")
    numbered = named(numbered, names)
    content = F.when(F.col("bytes") > 0, F.struct(*ORDER, "start", "size", "markdown"))
    filled = (blocks.join(crowded, PLACE, "left_anti").withColumn("cut", F.lit(0).cast("long")).unionByName(cut)
              .groupBy(*PLACE, "cut").agg(F.array_sort(F.collect_list(content)).alias("blocks")))
    full = numbered.join(filled, [*PLACE, "cut"]).join(texts, PAGE, "left")
    shown = F.transform("blocks", lambda b: F.when(b["start"].isNull(), b["markdown"]).otherwise(
        F.concat(F.lit("> "), in_bold(F.col("text"), b["start"], b["size"]), F.lit("\n"), b["markdown"])))
    return full.select("doc_id", "name", (F.col("piece_no") - 1).alias("piece_no"), F.array_join(shown, "").alias("markdown"),
                       *more_of(names))


def cut_by_bytes(blocks: DataFrame, place: list[str]) -> DataFrame:
    """Blocks with `cut`, the number of their piece within their place; numbers may be left out.

    A block belongs to the stretch of half of PIECE_BYTES in which it starts. Only the last block of a stretch can
    be longer than that; it is a piece by itself.
    """
    half = PIECE_BYTES // 2
    rows = blocks.withColumns({"_line": line_of(F.col("sort_y")), "_part": annot_block()})
    ran = running_total(rows, place, [["part", "outline_key", "_line"], ["sort_y", "_part"]], ["annot_idx"], "bytes", "_ran")
    return (ran.withColumn("cut", 2 * block_of(F.col("_ran"), half) + F.when(F.col("bytes") > half, 1).otherwise(0))
            .drop("_line", "_part", "_ran"))


def named(pieces: DataFrame, names: DataFrame) -> DataFrame:
    """Pieces with the name of their document, empty where it has none, and further columns of names.

    To be added before pieces have their text, which would else be shuffled by document.
    """
    return pieces.join(names, "doc_id", "left").withColumn("name", F.coalesce("name", F.lit("")))


def more_of(names: DataFrame) -> list[str]:
    return [c for c in names.columns if c not in ("doc_id", "name")]


def whole_documents(pieces: DataFrame) -> DataFrame:
    """One string for each document, for libraries whose documents are known to be small."""
    joined = F.expr("listagg(markdown, '') within group (order by piece_no)")
    return pieces.groupBy("doc_id", "name").agg(joined.alias("markdown"))
