"""Folders as relations of whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder_files(spark: SparkSession, folder: str, name: str = "") -> DataFrame:
    """(project, rel, data binary): every file below ``folder`` (a path or URI that executors can read), its path from there
    with forward slashes, and the project's name beside each."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = files.makeQualified(path).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select(F.lit(name).alias("project"), F.col("path").substr(F.lit(len(root) + 2), F.length("path")).alias("rel"), F.col("content").alias("data"))
