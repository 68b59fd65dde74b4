"""Nested annotation and outline files, a document's own JSON, as the library's flat tables.

Files come as rows (doc_id, content). They are parsed to VARIANT, so a file's fields, kinds and depth need not be
known before: what the library knows is taken out, and what cannot be read is kept apart with the reason.
Names of fields may start with a capital letter.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marginalia import schemas
from marginalia.functions.text import shown_kind
from marginalia.operators.stored import stored

# How files name the kinds that the library knows by another name.
KINDS = {"textnote": "note", "rectangle": "rect", "ink": "freehand", "freetext": "free_text"}
FILES = "doc_id long, content string"
ERRORS = "doc_id long, page_idx int, annot_idx int, reason string, record string"


def read_files(spark: SparkSession, path: str, names: DataFrame, suffix: str) -> DataFrame:
    """(doc_id, content) of the files below path whose name is a document's name (doc_id, name) without folders and
    with `suffix`, such as `.annotations.json`; other files are left out."""
    files = (spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
             .select(F.substring_index("_metadata.file_path", "/", -1).alias("_file"), F.col("value").alias("content")))
    own = names.select("doc_id", F.concat(F.substring_index("name", "/", -1), F.lit(suffix)).alias("_file"))
    return files.withColumn("_file", F.url_decode("_file")).join(own, "_file").select("doc_id", "content")


def annotation_records(files: DataFrame, discriminator: str = "type") -> DataFrame:
    """Annotations of files `{"pages": {"0": [record, ...], ...}}`, with `reason` for what cannot be read.

    A record is an object with its kind under `discriminator` and the fields of the flat table: color, contents, text (of
    a note), author, state, x, y, w, h, rects and points. annot_idx is its place in the page's list, whatever stands
    before it. Files without pages and pages without records have no rows. Kinds the library does not know are
    kept. `reason` is null for a good record; else it is one of "not JSON", "pages", "page number", "page",
    "record", "kind" and "field", and `record` is the text of the part that was not understood.
    """
    parsed = files.select("doc_id", "content", F.try_parse_json("content").alias("file"))
    broken = parsed.where("content is not null and file is null").select(
        "doc_id", *_no_place(), F.lit("not JSON").alias("reason"), F.col("content").alias("record"))
    opened = parsed.where("file is not null").select("doc_id", _part("file", "pages").alias("pages"))
    wrong = opened.where("pages is not null and not is_variant_null(pages) and schema_of_variant(pages) not like 'OBJECT%'")
    broken = broken.unionByName(wrong.select("doc_id", *_no_place(), F.lit("pages").alias("reason"), F.to_json("pages").alias("record")))
    pages = _opened(opened.where("schema_of_variant(pages) like 'OBJECT%'"), "pages").select(
        "doc_id", F.expr("try_cast(key as int)").alias("page_idx"), F.col("key").alias("number"), F.col("value").alias("page"))
    reason = (F.when(F.col("page_idx").isNull(), "page number")
              .when(~F.expr("schema_of_variant(page) like 'ARRAY%'"), "page"))
    pages = pages.withColumn("reason", reason)
    broken = broken.unionByName(pages.where("reason is not null").select(
        "doc_id", "page_idx", F.lit(None).cast("int").alias("annot_idx"), "reason",
        F.concat("number", F.lit(": "), F.to_json("page")).alias("record")))
    records = _opened(pages.where("reason is null"), "page").select(
        "doc_id", "page_idx", F.col("pos").alias("annot_idx"), F.col("value").alias("record"))
    flat = records.select("doc_id", "page_idx", "annot_idx", *_fields(discriminator), F.to_json("record").alias("record"),
                          F.expr("schema_of_variant(record) like 'OBJECT%'").alias("is_object"))
    reason = (F.when(~F.col("is_object"), "record").when(F.col("kind").isNull(), "kind").when(F.col("is_wrong"), "field"))
    flat = flat.withColumn("reason", reason).withColumn("record", F.when(F.col("reason").isNotNull(), F.col("record")))
    return flat.drop("is_object", "is_wrong").unionByName(broken, allowMissingColumns=True)


def annotations_of(records: DataFrame) -> DataFrame:
    """The flat annotation table of the good records; text markup of other kinds comes as highlights."""
    good = records.where("reason is null").select(*schemas.ANNOTATIONS.fieldNames())
    return good.withColumn("kind", shown_kind(F.col("kind")))


def errors_of(records: DataFrame) -> DataFrame:
    """What could not be read: (doc_id, page_idx, annot_idx, reason, record)."""
    return records.where("reason is not null").select("doc_id", "page_idx", "annot_idx", "reason", "record")


def read_annotation_files(spark: SparkSession, path: str, names: DataFrame,
                          suffix: str = ".annotations.json") -> tuple[DataFrame, DataFrame]:
    """The flat annotation table of the files below a path, and what could not be read."""
    records = stored(annotation_records(read_files(spark, path, names, suffix)))
    return annotations_of(records), errors_of(records)


def _opened(rows: DataFrame, column: str) -> DataFrame:
    """A row for each part (pos, key, value) of a VARIANT list or object."""
    return rows.sparkSession.sql(f"select * from {{rows}}, lateral variant_explode({column})", rows=rows)


def _no_place() -> list[Column]:
    return [F.lit(None).cast("int").alias(c) for c in ("page_idx", "annot_idx")]


def _part(of: str, name: str, kind: str = "variant") -> Column:
    """A field, whose name may start with a capital letter; null where it is not of the kind."""
    return F.coalesce(*(F.try_variant_get(F.col(of), f"$.{n}", kind) for n in (name, name[:1].upper() + name[1:])))


def _fields(discriminator: str) -> list[Column]:
    plain = F.lower(F.regexp_replace(_part("record", discriminator, "string"), "(?i)[_-]|annotation$", ""))
    names = F.create_map(*(F.lit(part) for pair in KINDS.items() for part in pair))
    boxes, points = "array<struct<x float, y float, w float, h float>>", "array<struct<x float, y float>>"
    kinds = {"color": "string", "contents": "string", "text": "string", "author": "string", "state": "string",
             "x": "float", "y": "float", "w": "float", "h": "float", "rects": boxes, "points": points}
    found = {name: _part("record", name, kind) for name, kind in kinds.items() if name not in ("rects", "points")}
    found |= {"rects": _corners("rects", "xywh"), "points": _corners("points", "xy")}
    given = {name: _part("record", name) for name in kinds}
    wrong = reduce(Column.__or__, (given[n].isNotNull() & ~F.is_variant_null(given[n]) & found[n].isNull() for n in kinds))
    columns = [c.alias("note_text" if n == "text" else n) for n, c in found.items()]
    return [F.coalesce(F.try_element_at(names, plain), plain).alias("kind"), *columns, F.coalesce(wrong, F.lit(False)).alias("is_wrong")]


def _corners(name: str, sides: str) -> Column:
    """Boxes or points, each an object; null if any has not all its numbers."""
    parts = F.transform(_part("record", name, "array<variant>"), lambda v: F.struct(*(
        F.coalesce(F.try_variant_get(v, f"$.{s}", "float"), F.try_variant_get(v, f"$.{s.upper()}", "float")).alias(s) for s in sides)))
    return F.when(F.forall(parts, lambda p: reduce(Column.__and__, (p[s].isNotNull() for s in sides))), parts)


def outline_of(files: DataFrame) -> DataFrame:
    """The flat outline of files `[entry, ...]` or `{"outline": [entry, ...]}`, an entry having title, page (may be
    absent) and children: (doc_id, title, page_idx, depth, outline_key), as `flatten_outline` makes it of parent links
    with an entry's place in its list as sibling_ord.

    Lists are opened level by level, so no depth is fixed. Files that are not JSON and parts that are not of
    this form are left out.
    """
    whole = files.select("doc_id", F.try_parse_json("content").alias("file"))
    top = F.when(F.expr("schema_of_variant(file) like 'ARRAY%'"), F.col("file")).otherwise(_part("file", "outline"))
    level = whole.select("doc_id", F.lit(None).cast("string").alias("above"), F.lit(0).alias("depth"), top.alias("entries"))
    levels = []
    while True:
        opened = _opened(level.where("schema_of_variant(entries) like 'ARRAY%'"), "entries").select(
            "doc_id", "depth", F.concat_ws("/", "above", F.lpad(F.col("pos").cast("string"), 19, "0")).alias("outline_key"),
            F.col("value").alias("entry"))
        seen = Observation()
        opened = stored(opened.where("schema_of_variant(entry) like 'OBJECT%'").select(
            "doc_id", "depth", "outline_key", F.coalesce(_part("entry", "title", "string"), F.lit("")).alias("title"),
            _part("entry", "page", "int").alias("page_idx"), _part("entry", "children").alias("entries")).observe(seen, F.count("*").alias("n")))
        if not seen.get.get("n"):
            break
        levels.append(opened.select("doc_id", "title", "page_idx", "depth", "outline_key"))
        level = opened.where("entries is not null").select(
            "doc_id", F.col("outline_key").alias("above"), (F.col("depth") + 1).alias("depth"), "entries")
    if not levels:
        return files.sparkSession.createDataFrame([], "doc_id long, title string, page_idx int, depth int, outline_key string")
    return reduce(DataFrame.unionByName, levels)
