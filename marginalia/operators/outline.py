"""Document outlines: from parent links to reading order, and one row per heading."""

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marginalia.operators.stored import stored

# Sorts after every outline key: the place of annotations that belong to no heading.
NO_HEADING = "~"
# Outlines of at most so many entries are walked through each in one go.
SMALL_OUTLINE = 4096


def flatten_outline(entries: DataFrame) -> DataFrame:
    """Entries with depth and `outline_key`, a string that sorts them in preorder.

    Outlines of few entries are walked through each by itself; others are joined level by level, from the roots
    down. Entries that hang from no root are left out, see `loose_entries`.
    """
    entries = entries.select("doc_id", "id", "parent_id", "sibling_ord",
                             F.coalesce("title", F.lit("")).alias("title"), "page_idx")
    sizes = entries.groupBy("doc_id").agg(F.count("*").alias("n"))
    large = stored(sizes.where(F.col("n") > SMALL_OUTLINE).select("doc_id"))
    listed = F.collect_list(F.struct("id", "parent_id", "sibling_ord", "title", "page_idx"))
    small = stored(entries.join(large, "doc_id", "left_anti").groupBy("doc_id").agg(listed.alias("entries"))
                   .mapInArrow(_walk, "doc_id long, entries array<struct<id long, title string, page_idx int, depth int, outline_key string>>")
                   .select("doc_id", F.inline("entries")))
    if large.isEmpty():
        return small
    return small.unionByName(_flatten_by_level(entries.join(large, "doc_id", "left_semi")))


def loose_entries(entries: DataFrame, flat: DataFrame) -> DataFrame:
    """Entries that hang from no root of their outline: below an entry that is not there, or in a circle."""
    return entries.join(flat.select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("id", pa.int64()), ("title", pa.string()), ("page_idx", pa.int32()), ("depth", pa.int32()),
                               ("outline_key", pa.string())]))
    for batch in batches:
        outlines = []
        for entries in batch["entries"].to_pylist():
            below: dict[int | None, list[dict]] = {}
            for entry in entries:
                below.setdefault(entry["parent_id"], []).append(entry)
            flat, waiting = [], [(entry, 0, "") for entry in below.pop(None, [])]
            while waiting:
                entry, depth, above = waiting.pop()
                key = above + str(entry["sibling_ord"]).zfill(19)
                flat.append({"id": entry["id"], "title": entry["title"], "page_idx": entry["page_idx"], "depth": depth, "outline_key": key})
                if entry["id"] is not None:
                    waiting.extend((child, depth + 1, key + "/") for child in below.get(entry["id"], ()))
            outlines.append(flat)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(outlines, kind)], ["doc_id", "entries"])


def _flatten_by_level(entries: DataFrame) -> DataFrame:
    level = entries.where(F.col("parent_id").isNull()).select(
        "doc_id", "id", "title", "page_idx", F.lit(0).alias("depth"),
        _ordinal(F.col("sibling_ord")).alias("outline_key"))
    children = entries.where(F.col("parent_id").isNotNull())
    levels = [level]
    while True:
        parents = level.select("doc_id", F.col("id").alias("parent_id"), "depth", "outline_key")
        placed = Observation()
        level = stored(children.join(parents, ["doc_id", "parent_id"]).select(
            "doc_id", "id", "title", "page_idx", (F.col("depth") + 1).alias("depth"),
            F.concat_ws("/", "outline_key", _ordinal(F.col("sibling_ord"))).alias("outline_key"))
            .observe(placed, F.count("*").alias("n")))
        if not placed.get.get("n"):
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)


def _ordinal(sibling_ord: Column) -> Column:
    return F.lpad(sibling_ord.cast("string"), 19, "0")


def dedup_outline(ol: DataFrame) -> DataFrame:
    """One row per (title, page): key and depth of its first entry, key of its last."""
    first = F.min(F.struct("outline_key", "depth"))
    return (ol.groupBy("doc_id", "title", "page_idx")
            .agg(first.alias("_first"), F.max("outline_key").alias("last_key"))
            .select("doc_id", "title", "page_idx", "_first.depth", "_first.outline_key",
                    "last_key"))


def page_headings(ol: DataFrame) -> DataFrame:
    """The heading in force at the end of each page that has one: its last in preorder.

    All entries take part, so a repeat of a chapter can win over the chapter's sub-section;
    the winner stands for the first entry with its title and page.
    """
    winner = F.max_by(F.struct("title", "depth", "outline_key"), "last_key")
    return (dedup_outline(ol).where(F.col("page_idx").isNotNull())
            .groupBy("doc_id", "page_idx").agg(winner.alias("heading")))
