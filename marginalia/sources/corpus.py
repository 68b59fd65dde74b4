"""An annotated library derived from the given `documents` and `events` tables.

Every document becomes a paged text of two lines a page, every event an annotation. Documents are numbered
by doc_id. A quarter of the events lie on the document with the event's user_id as its number, so some
documents have many; the others are dealt over all documents in turn, and all over all pages of their
document. One in twenty lies on a page behind the last, which has no text. All rows and whole texts take
part, whatever their ids.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import shown_kind
from marginalia.operators.blocks import PAGE, block_of, number_rows, spread_join
from marginalia.operators.outline import flatten_outline
from marginalia.operators.stored import stored

LINES_PER_PAGE = 2


def page_numbers() -> Column:
    """The last page of a text."""
    return F.call_function("div", F.size(F.split("text", "\n")) - 1, F.lit(LINES_PER_PAGE))


class Corpus:
    """Lazy tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.documents = spark.read.parquet(f"{folder}/documents.parquet")
        self.events = spark.read.parquet(f"{folder}/events.parquet")

    def names(self) -> DataFrame:
        return self.documents.select("doc_id", F.expr(
            "concat('library/', source, '/doc.', doc_id, '.pdf')").alias("name"))

    def bodies(self) -> DataFrame:
        """Pages as written, before the noise of text extraction."""
        lines = F.split("text", "\n")
        page = F.expr(f"transform(sequence(0, (size(lines) - 1) div {LINES_PER_PAGE}), i -> "
                      f"array_join(slice(lines, int({LINES_PER_PAGE} * i + 1), {LINES_PER_PAGE}), '\\n'))")
        return (self.documents.select("doc_id", lines.alias("lines"))
                .select("doc_id", F.posexplode(page).alias("page_idx", "body")))

    def page_text(self) -> DataFrame:
        """Extracted text: soft hyphens on even pages, doubled spaces on every fourth."""
        noisy = F.expr("""
            case when page_idx % 2 = 0 then replace(body, 'th', concat('t', char(173), 'h'))
                 when page_idx % 4 = 1 then replace(body, ' ', '  ') else body end""")
        return (self.bodies().where(F.length("body") > 0)
                .select(*PAGE, noisy.alias("text")))

    def outline_entries(self) -> DataFrame:
        """An entry for every page: chapters, sections and sub-sections by turns, the first
        without a page. Every third document has a second entry on each page, every fifth
        repeats its chapters."""
        pages = self.bodies().selectExpr(
            *PAGE, "regexp_extract(body, '^[^.\\n]*', 0) as title", "page_idx * 10L as own",
            """case when page_idx = 0 or page_idx % 4 = 2 then null when page_idx % 4 = 0
                 then (page_idx - 2) * 10L else (page_idx - 1) * 10L end as above""",
            "if(page_idx = 0, null, page_idx) as target")
        first = "struct(own as id, above as parent_id, own as sibling_ord, title, target as page_idx)"
        second = """if(doc_id % 3 = 0, struct(own + 1 as id, own as parent_id, own + 1 as sibling_ord,
                      concat('Sub ', title) as title, target as page_idx), null)"""
        repeat = """if(doc_id % 5 = 0 and above is null, struct(own + 9 as id, above as parent_id,
                      own + 9 as sibling_ord, title, target as page_idx), null)"""
        return pages.selectExpr(
            "doc_id", f"inline(filter(array({first}, {second}, {repeat}), e -> e is not null))")

    def marks(self) -> DataFrame:
        """Events as annotations, without their places in the page lists."""
        count = max(self.documents.count(), 1)
        spread = "(event_id div 4 * 3 + pmod(event_id, 4) - 1) * 7919"
        place = f"pmod(if(event_id % 4 = 0, user_id, {spread}), {count}L) + 1"
        placed = self.events.withColumn("place", F.expr(place)).join(self._numbered_documents(), "place")
        rows = placed.selectExpr(
            "event_id", "doc_id", """cast(if(event_id % 20 = 7, n_pages + event_id % 3,
                 (event_id * 31 + event_id div 1000) % n_pages) as int) as page_idx""",
            """case event_type when 'click' then case event_id % 13 when 0 then 'underline' when 1 then 'strikeout'
                 when 2 then 'squiggly' else 'highlight' end when 'view' then 'note'
                 when 'purchase' then 'rect' when 'error' then 'freehand'
                 else case event_id % 5 when 0 then 'stamp' when 1 then 'caret' when 2 then 'caret'
                 else 'free_text' end end as raw_kind""",
            """case event_id % 4 when 0 then '#FF0' when 1 then '#FFCC00' when 2 then '##00F'
                 else 'ff0000' end as color""",
            """case event_id % 3 when 0 then concat('com', char(173), 'ment  no.\\t', event_id)
                 when 1 then if(event_id % 7 = 0, ' \\t ', null) end as contents""",
            "if(event_type = 'view', concat('note ', event_id), null) as note_text",
            """case event_id % 4 when 1 then concat('reviewer ', user_id % 7)
                 when 2 then '  ' end as author""",
            "case event_id % 5 when 0 then 'Accepted' when 1 then 'Rejected' else 'None' end as state",
            "float((event_id * 37) % 500) as x",
            "float(if(event_type = 'click', (event_id * 53) % 60, (event_id * 53) % 700)) as y",
            "float(10 + event_id % 90) as w", "float(5 + event_id % 40) as h")
        return rows.withColumn("kind", shown_kind(F.col("raw_kind"))).selectExpr(
            "*",
            """case when kind = 'highlight' then filter(array(
                 if(event_id % 11 = 0, null, struct(x, y, w, h)),
                 if(event_id % 11 <> 0 and event_id % 3 = 0, struct(x, float(y + 24) as y, w, h), null)),
                 r -> r is not null) end as rects""",
            """case when kind = 'freehand' then filter(array(
                 if(event_id % 10 = 7, null, struct(x, y)),
                 if(event_id % 10 = 7, null, struct(float(x + w) as x, float(y + h) as y)),
                 if(event_id % 10 = 7, null, struct(float(x + w) as x, y))),
                 p -> p is not null) end as points""")

    def _numbered_documents(self) -> DataFrame:
        """doc_id and n_pages with `place`, counted from 1 by doc_id."""
        rows = self.documents.select("doc_id", (page_numbers() + 1).alias("n_pages"), F.lit(0).alias("_all"),
                                     block_of(F.col("doc_id")).alias("_block"))
        return number_rows(rows, ["_all"], [["_block"]], ["doc_id"], "place").drop("_all", "_block")

    def annotations(self) -> DataFrame:
        """Events as annotations; a page lists them by event_id."""
        numbered = number_rows(self.marks().withColumn("_part", block_of(F.col("event_id"))), PAGE,
                               [["_part"]], ["event_id"], "_number")
        return numbered.select(
            *PAGE, (F.col("_number") - 1).cast("int").alias("annot_idx"), "event_id", "kind",
            "color", "contents", "note_text", "author", "state", "x", "y", "w", "h", "rects", "points")

    def annotation_files(self) -> DataFrame:
        """The annotations as nested files (doc_id, content), 64 pages of a document in each."""
        record = F.expr("""to_json(struct(case kind when 'note' then 'TextNote' when 'free_text' then 'free_text'
            when 'rect' then 'RectAnnotation' else kind end as type, color, contents, note_text as text, author, state,
            x, y, w, h, rects, points))""")
        listed = F.array_sort(F.collect_list(F.struct("annot_idx", record.alias("record"))))
        pages = self.annotations().groupBy(*PAGE).agg(listed.alias("records")).select("doc_id", block_of(F.col("page_idx"), 64).alias("_file"), F.expr(
            "concat('\"', page_idx, '\": [', array_join(records.record, ', '), ']')").alias("page"))
        return pages.groupBy("doc_id", "_file").agg(F.collect_list("page").alias("pages")).selectExpr(
            "doc_id", """concat('{"version": 1, "pages": {', array_join(pages, ', '), '}}') as content""")

    def broken_files(self) -> DataFrame:
        """Annotation files of every twentieth document that cannot be read, or not all of them."""
        texts = ['{"pages": ', '{"pages": {"x": []}}', '{"pages": []}', '{"version": 1}',
                 '{"Pages": {"4": [7, {"color": "#FFF"}, {"type": "highlight", "rects": 5}, {"type": "stamp", "x": 1.5}], "5": {}}}']
        return self.documents.where("doc_id % 20 = 0").select("doc_id", F.explode(F.array(*map(F.lit, texts))).alias("content"))

    def outline_files(self) -> DataFrame:
        """The outlines as nested files (doc_id, content)."""
        entries = stored(self.outline_entries())
        depths = flatten_outline(entries).select("doc_id", "id", "depth")
        rows = stored(entries.join(depths, ["doc_id", "id"]))
        listed = F.expr("array_join(array_sort(collect_list(struct(sibling_ord, entry))).entry, ', ')")
        below = None
        for depth in range(rows.agg(F.max("depth")).first()[0] or 0, -1, -1):
            level = rows.where(F.col("depth") == depth)
            if below is None:
                level = level.withColumn("children", F.lit(None).cast("string"))
            else:
                level = level.join(below.withColumnRenamed("parent_id", "id"), ["doc_id", "id"], "left")
            entry = F.expr("""concat(rtrim('}', to_json(struct(title, page_idx as page))),
                              coalesce(concat(', "children": [', children, ']'), ''), '}')""")
            below = level.withColumn("entry", entry).groupBy("doc_id", "parent_id").agg(listed.alias("children"))
        return below.select("doc_id", F.concat(F.lit("["), "children", F.lit("]")).alias("content"))

    def page_entries(self) -> DataFrame:
        """The pages an annotation file lists, some without annotations: all pages of documents
        with an annotation."""
        return self.bodies().select(*PAGE).join(self.marks().select("doc_id"), "doc_id", "left_semi")

    def highlight_raw(self, ann: DataFrame) -> DataFrame:
        """Text found under the highlights of `annotations()`. It starts anywhere in the page, has doubled spaces and
        upper-case vowels; one in fifty is nowhere on the page."""
        marked = ann.where("kind = 'highlight'")
        bodies = self.bodies().where(F.length("body") > 0)
        marked = marked.select(*PAGE, "annot_idx", "event_id")
        return spread_join(marked, bodies, PAGE, "annot_idx", "inner").selectExpr(
            *PAGE, "annot_idx", "event_id",
            """case when event_id % 50 = 0 then 'no such passage'
               else translate(substr(replace(body, ' ', '  '),
                                     int(1 + (event_id * 7919) % length(body)),
                                     int(14 + event_id % 30)), 'aeiou', 'AEIOU') end as raw""")

    def glyphs(self, page_text: DataFrame) -> DataFrame:
        """Characters of the given pages on a grid, 80 to a row, 6 by 12 points each."""
        return (page_text.selectExpr(*PAGE, "posexplode(split(text, '')) as (i, ch)")
                .selectExpr(*PAGE, "i as glyph_idx", "ch", "float((i % 80) * 6) as x0",
                            "float((i div 80) * 12) as y0", "float((i % 80) * 6 + 6) as x1",
                            "float((i div 80) * 12 + 12) as y1"))

    def geometry(self) -> DataFrame:
        """Letter pages at 300 dpi, narrow in every seventh document; page 7 cannot be drawn."""
        pages = self.marks().select(*PAGE).distinct()
        return pages.selectExpr(
            *PAGE, "case when page_idx = 7 then null when doc_id % 7 = 0 then 1200 else 2550 end as bmp_w",
            "if(page_idx = 7, null, 3300) as bmp_h")
