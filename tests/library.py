"""Small input tables for tests."""

from pyspark.sql import types as T

from marginalia import schemas


def table(spark, schema, rows):
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def annotations(spark, rows):
    """Rows numbered by their order on the page unless they bring an annot_idx."""
    places, full = {}, []
    for row in rows:
        row = {"doc_id": 1, "color": "#FF0", "state": "None", **row}
        page = row["doc_id"], row["page_idx"]
        places[page] = places.get(page, -1) + 1
        full.append({"annot_idx": places[page], **row})
    return table(spark, schemas.ANNOTATIONS, full)


def outline(spark, headings, doc_id=1):
    """Nested (title, page[, children]) tuples as parent links."""
    rows = []

    def add(entries, parent):
        for place, (title, page, *children) in enumerate(entries):
            own = len(rows)
            rows.append({"doc_id": doc_id, "id": own, "parent_id": parent, "sibling_ord": place,
                         "title": title, "page_idx": page})
            add(children[0] if children else [], own)

    add(headings, None)
    return table(spark, schemas.OUTLINE_ENTRIES, rows)


def names(spark, *pairs):
    return table(spark, schemas.DOCUMENT_NAMES,
                 [{"doc_id": d, "name": n} for d, n in pairs or [(1, "test.pdf")]])


def page_text(spark, *rows):
    return table(spark, schemas.PAGE_TEXT,
                 [{"doc_id": 1, "page_idx": p, "text": t} for p, t in rows])


KEYED = [T.StructField("doc_id", T.LongType()), T.StructField("page_idx", T.IntegerType()),
         T.StructField("annot_idx", T.IntegerType())]


def keyed(spark, column, rows):
    """(page, annot, value) rows of document 1."""
    schema = T.StructType([*KEYED, T.StructField(column, T.StringType())])
    return spark.createDataFrame([(1, *r) for r in rows], schema)


def highlight(page, **more):
    return {"page_idx": page, "kind": "highlight", "rects": [(50.0, 50.0, 100.0, 10.0)], **more}


def note(page, text=None, **more):
    return {"page_idx": page, "kind": "note", "x": 100.0, "y": 100.0, "note_text": text, **more}


def rect(page, **more):
    return {"page_idx": page, "kind": "rect", "x": 50.0, "y": 50.0, "w": 400.0, "h": 200.0, **more}


def freehand(page, *points, **more):
    return {"page_idx": page, "kind": "freehand", "points": list(points), **more}


def caret(page, **more):
    return {"page_idx": page, "kind": "caret", "x": 100.0, "y": 200.0, "w": 10.0, "h": 20.0, **more}


def free_text(page, **more):
    return {"page_idx": page, "kind": "free_text", "x": 100.0, "y": 200.0, "w": 200.0, "h": 50.0, **more}
