"""Work folders, file systems and shipping of this package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

_OWN = "/tmp/checkpoints/weightloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    os.makedirs(_OWN, exist_ok=True)
    return f"file://{_OWN}"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under shared_dir. Results are read from it lazily, so only a private local one is removed, at exit."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if path.startswith(f"file://{_OWN}/"):
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return path


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of a plain path, which is local."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{os.path.abspath(uri)}"
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_weightloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="weightloom-")) / "weightloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._weightloom_shipped = True
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
