"""Tables between steps, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder = None


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody uses yet in ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temporary folder; any other session is
    refused, as its executors could not read each other's files.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        _own_folder = _own_folder or tempfile.TemporaryDirectory(prefix="basketry-tables-")
        folder = _own_folder.name
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table and read back, so that what reads it often computes it once.

    The table stays in the shared folder, as results may still read it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
