"""Tables and files between two steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or in a folder of our own where that is unset and all runs in one process; an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillpack-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parts(df: DataFrame, each: int = 32 << 20, least: int = 4) -> int:
    """How many parts of about `each` bytes df makes, as the optimizer estimates its size from its files."""
    return max(least, -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // each))


def located(path: str):
    """(file system, path in it) of a path or URI, by pyarrow."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def opened(path: str):
    """A file that can be read from anywhere in it."""
    system, at = located(path)
    return system.open_input_file(at)
