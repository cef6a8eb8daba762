"""What several operators share: settings, tables in the shared folder, components."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import time
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows and bytes handed to a Python worker at once; texts can be long.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 * 1024**2),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_own_folder = None
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` and send this package to the Python workers.

    The operators need none of the settings for right results. The package is sent
    once per application, unless it was installed as an archive (``--py-files``).
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    context, package = spark.sparkContext, Path(__file__).parent.parent
    if context.applicationId not in _shipped and package.is_dir():
        folder = tempfile.TemporaryDirectory(prefix="basketry-code-")
        code = Path(folder.name, "code", package.name)
        shutil.copytree(package, code, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder.name}/{package.name}", "zip", code.parent))
        _shipped[context.applicationId] = folder  # the driver serves the file from there
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temporary folder; any other
    session is refused, since executors could not read each other's files.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.TemporaryDirectory(prefix="basketry-")
    return _own_folder.name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a frame as a table in the shared folder and read it from there.

    Cuts lineage: what follows survives lost executors without recomputing ``df``.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def forget(df: DataFrame) -> None:
    """Delete a table written by :func:`keep` that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps now.

    It deletes them when the driver's collector finds that nothing refers to them, and
    collects by itself every half hour only (``spark.cleaner.periodicGC.interval``).
    What a job that has just ended used is let go by the second time.
    """
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.3)


_in_worker: dict = {}


def in_worker(key, make, beside: bool = False):
    """What ``make`` gave for a key, kept by a Python worker from batch to batch.

    A worker serves many tasks and keeps the state of one operator at a time, so the
    memory of successive operators does not add up; with ``beside`` the state joins what
    the same operator keeps already.
    """
    if key not in _in_worker:
        if not beside:
            _in_worker.clear()
            give_back_memory()
        _in_worker[key] = make()
    return _in_worker[key]


def give_back_memory() -> None:
    """Return a worker's free memory, of Arrow and of the heap, to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph with edges (a, b): the least node reachable.

    Alternates two steps that hang nodes on smaller neighbours (Kiveris et al.,
    2014) until every edge leads from a node to its component. Each step is a
    minimum per node, which combines before the shuffle, and a join whose large
    side Spark may split, so a node with very many edges does no harm. Edges with
    a null end and loops are ignored; nodes without an edge are not returned.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    table = keep(pairs.distinct(), "edges")
    while True:
        is_start = table.select("b").distinct()
        chained = table.select("a").join(is_start, F.col("a") == F.col("b"), "left_semi")
        twice = table.groupBy("a").count().where("count > 1")
        if chained.isEmpty() and twice.isEmpty():
            break
        both = table.select("a", "b").unionAll(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low"))
        lowest = lowest.select(F.col("a").alias("at"), F.least("a", "low").alias("low"))
        hung = (
            both.where("b > a")
            .join(lowest, F.col("a") == F.col("at"))
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .distinct()
        )
        lowest = hung.groupBy("a").agg(F.min("b").alias("low"))
        smaller = (
            hung.join(lowest.withColumnRenamed("a", "at"), F.col("a") == F.col("at"))
            .where("b <> low")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        after = keep(lowest.select("a", F.col("low").alias("b")).unionAll(smaller).distinct(), "edges")
        forget(table)
        table = after
    ends = table.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return table.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(ends)
