"""Names of the files a document is written to."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import file_stem

# Between the stem and the doc_id of a document whose stem another document has too.
OWN_MARK = "~"


def file_stems(names: DataFrame) -> DataFrame:
    """(doc_id, stem) of documents (doc_id, name): the name without its extension, a different one for each.

    Of documents whose names differ in nothing but the extension, the one with the smallest doc_id keeps the stem, the
    others get their doc_id behind it, as do names that look as if they had one and empty ones. Parts of a
    path that lead upwards or nowhere are left out. A document that repeats keeps its first name.
    """
    parts = F.filter(F.split("name", "/"), lambda p: ~p.isin("", ".", ".."))
    known = names.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("name", F.lit(""))).alias("name"))
    stems = known.select("doc_id", file_stem(F.array_join(parts, "/")).alias("plain"))
    is_marked = (F.col("plain") == "") | F.regexp_like("plain", F.lit(f"{OWN_MARK}-?[0-9]+$"))
    shared = (stems.where(~is_marked).groupBy("plain").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
              .where("n > 1").select("plain", "first"))
    own = F.concat("plain", F.lit(OWN_MARK), F.col("doc_id").cast("string"))
    return stems.join(shared, "plain", "left").select(
        "doc_id", F.when(is_marked | (F.col("first") != F.col("doc_id")), own).otherwise(F.col("plain")).alias("stem"))


def with_file_names(pieces: DataFrame, stems: DataFrame, suffix: str = "-annotations.md") -> DataFrame:
    """Pieces with file_name, from the stems of their documents."""
    name: Column = F.concat(F.coalesce("stem", F.concat(F.lit(OWN_MARK), F.col("doc_id").cast("string"))), F.lit(suffix))
    return pieces.join(stems, "doc_id", "left").withColumn("file_name", name).drop("stem")
