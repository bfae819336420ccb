"""Tar shards: a header index cuts them into byte ranges, each an input partition of its own; and their writer.

The index is a Spark job, a task a shard, that goes from header to header and reads no content. It cuts a shard where a sample begins, at the first
such place behind `split` bytes. A range is then read by one task, member by member, and handed on in batches of `batch` bytes, so a task
holds a batch and one sample, whatever the shard's size. Compressed shards can't be cut; they are one range, still read as a stream.
"""

from __future__ import annotations

import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .scratch import located, opened

SPLIT, BATCH, LARGEST = 256 << 20, 16 << 20, 1 << 30
PACKED = (".gz", ".tgz", ".bz2", ".xz")
SAMPLE = "shard string, sample_idx long, key string, members map<string,binary>, error string"


def split_name(name: str) -> tuple[str, str]:
    """(sample, member) of a file in a shard: the base name up to its first dot, and the rest."""
    folder, _, base = name.rpartition("/")
    stem, _, ext = base.partition(".")
    return (f"{folder}/{stem}" if folder else stem), ext


def _members(tar: tarfile.TarFile, end: int | None = None) -> Iterator[tarfile.TarInfo]:
    """Files in order, up to a header at `end`; what tarfile remembers of them is dropped."""
    # the first header is read when a file is opened; offset is where the next one lies
    while tar.firstmember is not None or end is None or tar.offset < end:
        m = tar.next()
        if m is None:
            break
        if m.isfile():
            yield m
        tar.members = []


def cut(path: str, split: int = SPLIT) -> Iterator[dict]:
    """Ranges (start, end, first sample) of a shard, in order, and where it is damaged the error behind them."""
    if path.endswith(PACKED):
        yield {"shard": path, "start": 0, "end": None, "first": 0, "error": None}
        return
    start = first = i = at = 0
    key, error, any_sample = None, None, False
    try:
        with opened(path) as f, tarfile.open(fileobj=f, mode="r:") as tar:
            size = f.size()
            for m in _members(tar):
                if m.offset_data + m.size > size:
                    raise tarfile.ReadError("unexpected end of data")
                k, _ = split_name(m.name)
                if k != key:
                    i += any_sample
                    if any_sample and m.offset - start >= split:
                        yield {"shard": path, "start": start, "end": m.offset, "first": first, "error": None}
                        start, first = m.offset, i
                    key, any_sample = k, True
                at = m.offset + 1
            # a header that is none ends the walk as the zeros behind the last file do
            f.seek(tar.offset)
            if any(f.read(512)):
                raise tarfile.ReadError(f"no header at {tar.offset}")
    except (tarfile.TarError, EOFError, OSError) as e:
        error = f"{type(e).__name__}: {e}"
    if any_sample:
        # headers up to the last whole one
        yield {"shard": path, "start": start, "end": at, "first": first, "error": None}
    if error is not None:
        yield {"shard": path, "start": None, "end": None, "first": None, "error": error}


def tar_index(spark: SparkSession, *paths: str, split: int = SPLIT) -> DataFrame:
    """shard, start, end, first, error: the ranges of all shards; a task a shard, no content is read."""
    ddl = "shard string, start long, end long, first long, error string"
    schema = pa.schema([("shard", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("first", pa.int64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(list(cut(path, split)), schema=schema)

    shards = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path")
    return shards.repartition(max(1, min(shards.count(), 10_000)), "path").mapInArrow(run, ddl)


def samples(path: str, start: int, end: int | None, first: int, largest: int = LARGEST) -> Iterator[tuple]:
    """(sample_idx, key, members, error) of a range. A member over `largest` bytes isn't read; its sample comes with an error in its place."""
    key, members, error, i = None, {}, None, first
    try:
        with opened(path) as f:
            f.seek(start)
            with tarfile.open(fileobj=f, mode="r|*" if path.endswith(PACKED) else "r:") as tar:
                for m in _members(tar, end):
                    k, ext = split_name(m.name)
                    if key is not None and k != key:
                        yield i, key, None if error else members, error
                        members, error, i = {}, None, i + 1
                    key = k
                    if m.size > largest:
                        error = f"{m.name}: {m.size} bytes"
                    elif not error:
                        members[ext] = tar.extractfile(m).read()
    except (tarfile.TarError, EOFError, OSError) as e:
        if key is not None:
            yield i, key, None if error else members, error
        yield None, None, None, f"{type(e).__name__}: {e}"
        return
    if key is not None:
        yield i, key, None if error else members, error


@dataclass
class Range(InputPartition):
    shard: str
    start: int | None
    end: int | None
    first: int | None
    error: str | None
    #: Ranges of the shard that the same task reads behind this one.
    more: tuple[Range, ...] = ()


def dealt(ranges: list[list], size: int) -> Iterator[Range]:
    """Ranges that follow each other in a shard, put together up to size bytes; longer ones, and those without an end, by themselves."""
    own, total = [], 0
    for r in (Range(*x) for x in ranges):
        n = size + 1 if r.start is None or r.end is None else r.end - r.start
        if own and (own[-1].shard != r.shard or total + n > size):
            yield replace(own[0], more=tuple(own[1:]))
            own, total = [], 0
        own.append(r)
        total += n
    if own:
        yield replace(own[0], more=tuple(own[1:]))


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.ranges = json.loads(options["ranges"])
        self.batch, self.largest = int(options.get("batch", BATCH)), int(options.get("largest", LARGEST))

    def __getstate__(self) -> dict:
        # every task is sent the reader, and needs its own ranges alone
        return {k: v for k, v in self.__dict__.items() if k != "ranges"}

    def partitions(self) -> list[Range]:
        return list(dealt(self.ranges, self.batch))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for own in (partition, *partition.more):
            yield from self._read(own)

    def _read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.string()), ("sample_idx", pa.int64()), ("key", pa.string()), ("members", pa.map_(pa.string(), pa.binary())), ("error", pa.string())])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

        if partition.error is not None:
            yield made([(partition.shard, None, None, None, partition.error)])
            return
        rows, size = [], 0
        for i, key, members, error in samples(partition.shard, partition.start, partition.end, partition.first, self.largest):
            own = sum(map(len, (members or {}).values()))
            if rows and (size + own > self.batch or len(rows) >= 10_000):
                yield made(rows)
                rows, size = [], 0
            rows.append((partition.shard, i, key, None if members is None else list(members.items()), error))
            size += own
        if rows:
            yield made(rows)


class TarSource(DataSource):
    """Format tar_ranges: ranges (JSON lists of shard, start, end, first sample, error), batch, largest."""

    @classmethod
    def name(cls) -> str:
        return "tar_ranges"

    def schema(self) -> str:
        return SAMPLE

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(self.options)


def tar_samples(spark: SparkSession, *paths: str, split: int = SPLIT, batch: int = BATCH, largest: int = LARGEST) -> DataFrame:
    """shard, sample_idx, key, members (name -> bytes), error: files that share a base name and follow each other are a sample.

    A damaged shard gives the samples in front of the damage and one row with the error; a sample with a member over `largest` bytes gives its
    error and no members. The ranges, about a hundred bytes for `split` bytes of shards, are planned by the driver, as file splits are.
    """
    ranges = [tuple(r) for r in tar_index(spark, *paths, split=split).orderBy("shard", F.asc_nulls_last("start")).collect()]
    if not ranges:
        return spark.createDataFrame([], SAMPLE)
    spark.dataSource.register(TarSource)
    return spark.read.format("tar_ranges").option("ranges", json.dumps(ranges)).option("batch", batch).option("largest", largest).load()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class TarWriter(DataSourceWriter):
    """Rows (shard, name, content), those of a shard in one task and together; shards appear when all tasks are done."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.run = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        import io

        system, root = located(self.path)
        out, tar, files = None, None, []

        def close() -> None:
            if tar is not None:
                tar.close()
                out.close()

        pending = f"{root}/_pending-{self.run}"
        system.create_dir(pending)
        try:
            for r in rows:
                if not files or files[-1][1] != f"{root}/{r['shard']}":
                    close()
                    files.append((f"{pending}/{uuid.uuid4().hex}", f"{root}/{r['shard']}"))
                    out = system.open_output_stream(files[-1][0])
                    tar = tarfile.open(fileobj=out, mode="w|")
                info = tarfile.TarInfo(r["name"])
                info.size = len(r["content"])
                tar.addfile(info, io.BytesIO(r["content"]))
        finally:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = located(self.path)
        for m in messages:
            for a, b in m.files if m else []:
                system.move(a, b)
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*located(self.path))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        pending = f"{root}/_pending-{self.run}"
        if system.get_file_info(pending).type != fs.FileType.NotFound:
            system.delete_dir(pending)


class TarSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def writer(self, schema: StructType, overwrite: bool) -> TarWriter:
        return TarWriter(self.options)


def write_tar(files: DataFrame, path: str, *order: str) -> None:
    """Shards of files (shard, name, content, and what they are ordered by); a shard is written by one task, and none appears if a task fails."""
    files.sparkSession.dataSource.register(TarSink)
    dealt = files.repartition("shard").sortWithinPartitions("shard", *order)
    dealt.select("shard", "name", F.col("content").cast("binary").alias("content")).write.format("tar_shards").mode("append").save(path)
