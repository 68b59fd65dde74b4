"""Training-data pipeline over `documents`: language, near copies, benchmark passages, batches.

A stage works on all that the one before it kept, and returns the columns of documents; the last returns the
pieces of documents with their batches. A null text has no letters, so the first stage rejects it; a
document without doc_id is judged like any other. Every row is judged by its own text, also where rows repeat
a doc_id or have none.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontamination, language, packing, simhash
from marginalia.llm.queries import as_page_text, labelled_for_training
from marginalia.operators.stored import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin."""
    dictionaries = language.fit_dictionaries(labelled_for_training(docs))
    return language.told_rows(docs, dictionaries)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near copies.

    Where rows repeat a doc_id, those that stand for a class are told by their fingerprints, and one of each
    class stays.
    """
    classes = stored(simhash.near_duplicate_pages(as_page_text(docs)))
    first = F.col("doc_id").eqNullSafe(F.col("class_doc_id"))
    ids = classes.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(first).alias("first")).where("first")
    own = F.col("row.doc_id")
    once = _joined(docs, ids.where("rows = 1"), own, "left_semi")
    if ids.where("rows > 1").isEmpty():
        return once
    firsts = classes.where(first).select(F.col("doc_id").alias("id"), "fingerprint", "class_fingerprint").distinct()
    again = _wrapped(_joined(docs, ids.where("rows > 1"), own, "left_semi")).withColumn("own", simhash.fingerprint_of(F.col("row.text")))
    again = (again.join(firsts, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("fingerprint")))
             .dropDuplicates(["id", "class_fingerprint"]).select("row.*"))
    return once.unionByName(again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages in a twentieth of their words.

    The verdict hangs on the text alone, so the key of a row is the digest of its text; a null text is clean.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = docs.select(_digest(F.col("text")).alias("doc_id"), "text")
    pages = decontamination.contaminated_pages(as_page_text(texts), items)
    return _joined(docs, pages.where("contaminated"), _digest(F.col("row.text")), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the batch each belongs to."""
    lengths = as_page_text(docs).withColumn("n_tokens", packing.word_count(F.col("text")))
    return packing.pack_pages(lengths).drop("page_idx")


def _joined(docs: DataFrame, pages: DataFrame, key: Column, how: str) -> DataFrame:
    """Documents whose key is a doc_id of pages, or is not; their own columns may have any names."""
    ids = pages.select(F.col("doc_id").alias("id")).distinct()
    return _wrapped(docs).join(ids, key.eqNullSafe(F.col("id")), how).select("row.*")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _wrapped(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row"))


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontaminate), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each reading what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, stored(docs) if place else docs, sf_dir)
    return docs
