"""Reading the input tables and writing digests."""

from pyspark.sql import DataFrame, SparkSession, types as T

from marginalia import schemas
from marginalia.functions.text import shown_kind


def read_table(spark: SparkSession, path: str, schema: T.StructType,
               format: str = "parquet") -> DataFrame:
    """A table in a columnar or JSON format, with a fixed schema and no inference."""
    return spark.read.format(format).schema(schema).load(path)


def read_annotations(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Annotations; text markup of other kinds comes as highlights."""
    rows = read_table(spark, path, schemas.ANNOTATIONS, format)
    return rows.withColumn("kind", shown_kind(rows["kind"]))


def read_outline(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.OUTLINE_ENTRIES, format)


def read_page_text(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.PAGE_TEXT, format)


def read_glyphs(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.GLYPHS, format)


def read_geometry(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.PAGE_GEOMETRY, format)


def read_names(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.DOCUMENT_NAMES, format)


def write_digests(digests: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write (doc_id, name, file_name, piece_no, markdown) rows as a parquet table.

    The pieces of a document lie in one file, or in neighbouring ones, in order.
    """
    digests.repartitionByRange("doc_id", "piece_no").sortWithinPartitions("doc_id", "piece_no").write.mode(mode).parquet(path)
