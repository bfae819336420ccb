"""What the operators of this package share: scratch tables, folds, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts of about so many bytes are handled at a time inside an Arrow batch.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch: a row is a whole text, and an executor holds some batches for each of its cores.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2500
#: Bytes of one: few rows where texts are long. Both hold where the session has Spark's own default.
BATCH_SIZE, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs in one process (tests); an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillpack-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Paths of the tables written within passing(), innermost last.
_passing: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written to the shared folder and read again: its lineage starts at files that outlive executors.

    The table stays until the folder is cleaned up, or, within passing(), until that ends unless it is to be kept.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if _passing and not keep:
        _passing[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables materialised within are deleted at the end; what goes on may read those alone that were kept."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        # Spark removes the shuffle files of plans that nothing refers to when the driver collects garbage
        gc.collect()
        spark._jvm.System.gc()


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def least_hashed(rows: DataFrame, by: str, most: Column, order: list[str], parts: int = 64) -> DataFrame:
    """Of every value of `by`, the `most` rows (a column) that come first by h and order. They meet in one task after each of `parts` tasks has left no more."""
    out = rows.withColumn("part", F.pmod(F.col("h"), F.lit(parts)))
    for keys in ([by, "part"], [by]):
        out = out.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("h", *order))).where(F.col("n") <= most)
    return out.drop("part", "n")


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


_owner = ""


def forget_others(owner: str) -> None:
    """In a reused worker: what modules remember for another step is dropped, and its memory given back."""
    global _owner
    if owner == _owner:
        return
    _owner = owner
    for name, module in list(sys.modules.items()):
        if name.startswith(f"{__package__}.") and hasattr(module, "forget"):
            module.forget()
    gc.collect()
    give_back()


def give_back() -> None:
    """Memory that is free in this worker goes back to the system; workers that wait for their next task keep theirs otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str) -> DataFrame:
    """mapInArrow whose function yields dicts of columns."""

    conf = df.sparkSession.conf
    if conf.get(BATCH) == "10000":  # Spark's own default; what a user has set stays
        conf.set(BATCH, BATCH_ROWS)
    if conf.get(BATCH_SIZE) == "67108864b":
        conf.set(BATCH_SIZE, str(BATCH_BYTES))
    schema = arrow_schema(ddl)
    owner = f"{f.__module__}.{f.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        for out in f(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for t, x in ((t, out[t.name]) for t in schema)], schema=schema)
        give_back()

    return df.mapInArrow(run, ddl)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def text_slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts as an Arrow array) of about limit bytes each; a null text is empty."""
    texts = pc.fill_null(column(batch, text).cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, texts.slice(a, b - a)
        a = b


def parts_for(df: DataFrame, each: int, most: int = 20_000) -> int:
    """How many parts of about `each` bytes df makes, as the optimizer estimates its size; as many as shuffles have at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, size // each))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about limit characters each; a null text is empty."""
    out: list[str] = []
    size = first = 0
    for i, t in enumerate(column(batch, text)):
        out.append(t.as_py() or "")
        size += len(out[-1])
        if size >= limit:
            yield first, out
            out, size, first = [], 0, i + 1
    if out:
        yield first, out
