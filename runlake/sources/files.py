"""Knowledge files: whole text files below a folder, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path and text of every file of a suffix (``.md``, ``.json``), folders within folders included.

    A guide or a rule list is one document and read as one; logs are read as lines, never here.
    """
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
