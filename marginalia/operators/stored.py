"""Intermediate tables that are written once and read several times."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder = None


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table below the cluster's checkpoint folder and read it back.

    Cuts the lineage and outlives lost executors. Unlike a checkpoint the table keeps column
    pruning, filters at the scan, and a size that join planning can check.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    """A path in the application's own folder below the checkpoint folder, not yet in use."""
    return f"{_run_folder(spark)}/{uuid.uuid4().hex}"


def drop_stored(spark: SparkSession) -> None:
    """Delete all that this application has stored; call it when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _run_folder(spark: SparkSession) -> str:
    return f"{_folder(spark)}/{spark.sparkContext.applicationId}"


def _folder(spark: SparkSession) -> str:
    """The folder the cluster names; it must be shared, whatever its scheme. Local mode may do without."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/") + "/marginalia"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.TemporaryDirectory(prefix="marginalia-")
    return _local_folder.name
