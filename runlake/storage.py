"""Where jobs put tables: below a base path that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def base_path(spark: SparkSession) -> str:
    """The session's folder below ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; any other session is an error,
    because its executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="runlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/runlake-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the session's folder that nothing has used."""
    return f"{base_path(spark)}/{tag}-{uuid.uuid4().hex}"


def drop_tables(spark: SparkSession) -> None:
    """Removes the session's folder; frames that still read from it can't be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base_path(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
