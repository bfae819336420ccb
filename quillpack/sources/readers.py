"""Sources: Parquet with row ordinals and row groups, JSON lines, prompt lists, frame folders; all lazily, by Spark's file systems."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..functions.text import blank, padded_name, strip
from .scratch import opened


def file_list(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """path, size of the files under folder whose names match, by path; no file is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length").orderBy("path")


def parquet_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows with file_path and row_index, the ordinal in the file; damaged files are skipped."""
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(*paths)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


def row_groups(spark: SparkSession, *paths: str) -> DataFrame:
    """file, row_group, first_row, n_rows: executors read the files' footers, and nothing else of them."""
    schema = pa.schema([("file", pa.string()), ("row_group", pa.int32()), ("first_row", pa.int64()), ("n_rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as f:
                    meta = pq.read_metadata(f)
                n = np.array([meta.row_group(g).num_rows for g in range(meta.num_row_groups)], "i8")
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(n), pa.string()), pa.array(np.arange(len(n), dtype="i4")), pa.array(np.cumsum(n) - n), pa.array(n)], schema=schema)

    # paths and lengths alone: contents are pruned
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(list(paths)).select("path")
    return files.repartition("path").mapInArrow(run, "file string, row_group int, first_row long, n_rows long")


#: Rows of a file that share a key in the interval join.
STRIDE = 4096


def positioned(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows with file_path, row_group and row, the ordinal in its group.

    Groups and rows meet by file and stride of STRIDE rows (a group once for each stride that it touches), then by the group's interval.
    """
    rows = spark.read.option("recursiveFileLookup", "true").parquet(*paths)
    rows = rows.select("*", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file_path"), F.col("_metadata.row_index").alias("at"))
    strides = F.sequence(F.floor(F.col("first_row") / STRIDE), F.floor((F.col("first_row") + F.col("n_rows") - 1) / STRIDE))
    groups = row_groups(spark, *paths).where("n_rows > 0").select(F.col("file").alias("file_path"), "row_group", "first_row", "n_rows", F.explode(strides).alias("stride"))
    met = rows.withColumn("stride", F.floor(F.col("at") / STRIDE)).join(groups, ["file_path", "stride"])
    return met.where((F.col("at") >= F.col("first_row")) & (F.col("at") < F.col("first_row") + F.col("n_rows"))).withColumn("row", F.col("at") - F.col("first_row")).drop("at", "stride", "first_row", "n_rows")


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """line, value: the lines of text files, numbered from 0 in the order of the files' paths, then of the file, however files are split.

    Two passes over the same splits: lines of each split are counted, and the counts summed up in order; then each line has its place in its split,
    and its split's sum. A task numbers its rows as it reads them, so a split's first number gives its lines' places.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(list(paths))
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # one row a split of a file: as many as tasks
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select(F.col("file"), F.col("block"), (before - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(offsets), ["file", "block"]).select((F.col("id") + F.col("shift")).alias("line"), "value")


def json_lines(spark: SparkSession, path: str, schema: str, seed: int | None = None, most: int | None = None) -> DataFrame:
    """line (its ordinal), value: decoded lines, in a drawn order and the first `most` of it if asked for; null where a line is no JSON."""
    lines = text_lines(spark, path)
    if seed is not None:
        lines = lines.orderBy(draw(seed, "lines", "line"), "line")
    if most is not None:
        lines = (lines if seed is not None else lines.orderBy("line")).limit(most)
    return lines.select("line", F.from_json("value", schema).alias("value"))


def prompts(lines: DataFrame, text: str, order: list[str]) -> DataFrame:
    """order, text stripped, without the blank ones."""
    return lines.where(~blank(F.col(text))).select(*order, strip(F.col(text)).alias(text))


def output_name(n, width: int = 3):
    return padded_name(n, width)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """path, number of the images in a folder, by the number at the end of the name, -1 without one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder).select("path")
    n = F.regexp_extract("path", r"_(\d+)\.jpg$", 1)
    return files.select("path", F.when(n == "", F.lit(-1)).otherwise(F.try_to_number(n, F.lit("999999999"))).cast("int").alias("number")).orderBy("number", "path")


def shard_names(index: DataFrame, value: str) -> DataFrame:
    """Distinct shard names of a checkpoint index (JSON with weight_map), by first appearance."""
    parsed = index.select(F.from_json(value, "struct<weight_map:map<string,string>>")["weight_map"].alias("m"))
    return parsed.select(F.posexplode(F.array_distinct(F.map_values("m"))).alias("ord", "shard"))
