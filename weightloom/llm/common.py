"""What the operators of this subpackage share: tables, files sent to executors, Arrow helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from weightloom.runtime import open_fs, shared_dir, ship, work_dir

__all__ = ["documents", "open_fs", "pages", "shared_dir", "ship", "ship_file", "shipped", "shuffle_partitions", "slices", "spread", "work_dir"]
#: Bytes of text that one Arrow batch handed to Python may hold; Spark also limits rows.
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a local file to the executors once; returns the name by which `shipped` finds it there."""
    sc = spark.sparkContext
    if not hasattr(sc, "_weightloom_files"):
        sc._weightloom_files = {}
    path = os.path.abspath(path)
    if path not in sc._weightloom_files:
        name = f"{uuid.uuid4().hex}-{os.path.basename(path)}"
        folder = tempfile.mkdtemp(prefix="weightloom-")
        shutil.copyfile(path, os.path.join(folder, name))
        sc.addFile(os.path.join(folder, name))
        sc._weightloom_files[path] = name
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return sc._weightloom_files[path]


def shipped(name: str) -> str:
    """Where a file sent by `ship_file` lies on this machine; a path of any other file as it is."""
    return name if os.path.isabs(name) else SparkFiles.get(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where their input has fewer splits than that, as one large row group has; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES):
    """Zero-copy parts of a batch with about `limit` bytes of the column each; a longer text stands alone."""
    held = batch.column(column)
    if pa.types.is_list(held.type):
        sizes = [(held.nbytes // max(1, len(held)))] * len(held)
    else:
        sizes = pc.fill_null(pc.binary_length(held), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
