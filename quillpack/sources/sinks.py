"""Sinks: packed tables, resumable positions, metrics, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_packs(packs: DataFrame, path: str) -> None:
    packs.write.mode("overwrite").partitionBy("rank", "worker").parquet(path)


def write_offsets(offsets: DataFrame, path: str, step: int) -> str:
    """Positions of a step, in a directory named by its number in seven digits."""
    where = f"{path.rstrip('/')}/{step:07d}"
    offsets.write.mode("overwrite").parquet(where)
    return where


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def read_offsets(spark: SparkSession, path: str) -> tuple[DataFrame, int] | None:
    """Positions of the latest step, and the step to go on with; None where nothing was saved."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException:
        return None
    df = df.withColumn("step", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{7})/[^/]*$", 1).cast("int"))
    step = df.agg(F.max("step")).first()[0]
    return None if step is None else (df.where(F.col("step") == step).drop("step"), step + 1)
