"""Endless passes over Parquet files as a stream that goes on where it stopped.

An offset is the place of the next row: (epoch, file, row group, row). Files come by path, and every epoch has the same order. A batch is what lies
between two offsets, cut by row groups into input partitions, so it can be read again as often as needed; Spark's checkpoint says where a query
goes on. How far a batch may go is only known to the source, which therefore notes each end in a small file before it names it: an end is never before
one that Spark has logged, and what was named but not logged is part of the next batch.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.readers import row_groups
from ..sources.scratch import located, opened

PLACE = ("epoch", "file", "row_group", "row")
#: Rows of an input partition, at least, and input partitions of a batch, about at most: each reads its file's footer.
PIECE, PIECES = 1 << 16, 256


class Places:
    """Offsets and their ordinals in an endless sequence of rows; groups: (path, row group, rows), in order."""

    def __init__(self, groups: list[list]):
        self.groups = [g for g in groups if g[2]]
        self.files = {p: i for i, p in enumerate(dict.fromkeys(g[0] for g in groups))}
        self.first, self.total = [], 0
        for _, _, n in self.groups:
            self.first.append(self.total)
            self.total += n
        self.at = {(self.files[p], g): first for (p, g, _), first in zip(self.groups, self.first, strict=True)}
        self.rows_of = {(self.files[p], g): n for p, g, n in self.groups}

    def ordinal(self, place: dict) -> int:
        return place["epoch"] * self.total + (self.at[place["file"], place["row_group"]] + place["row"] if self.total else 0)

    def place(self, ordinal: int) -> dict:
        if not self.total:
            return dict.fromkeys(PLACE, 0)
        epoch, row = divmod(ordinal, self.total)
        i = bisect.bisect_right(self.first, row) - 1
        path, group, _ = self.groups[i]
        return dict(zip(PLACE, (epoch, self.files[path], group, row - self.first[i]), strict=True))

    def between(self, start: int, end: int) -> Iterator[tuple]:
        """(epoch, file, path, group, from, to) of the rows from start up to end."""
        while start < end:
            epoch, row = divmod(start, self.total)
            i = bisect.bisect_right(self.first, row) - 1
            path, group, n = self.groups[i]
            a = row - self.first[i]
            b = min(n, a + end - start)
            yield epoch, self.files[path], path, group, a, b
            start += b - a


@dataclass
class Piece(InputPartition):
    """Rows first up to last, counted from the beginning of the first of some row groups (group, rows) of a file."""

    epoch: int
    file: int
    path: str
    groups: list[tuple[int, int]]
    first: int
    last: int


def pieces(places: Places, start: int, end: int) -> Iterator[Piece]:
    """The rows from start up to end: row groups that follow each other in a file, put together up to PIECE rows or a PIECES-th of all."""
    size = max(PIECE, -(-(end - start) // PIECES))
    own: Piece | None = None
    for epoch, file, path, group, a, b in places.between(start, end):
        n = places.rows_of[file, group]
        if own and (own.epoch, own.file) == (epoch, file) and own.last - own.first + b - a <= size:
            own.last += b - a
            own.groups.append((group, n))
            continue
        if own:
            yield own
        own = Piece(epoch, file, path, [(group, n)], a, b)
    if own:
        yield own


class EpochReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.places = Places(json.loads(options["groups"]))
        self.rows, self.notes = int(options["rows"]), options["notes"]
        self.start = json.loads(options["start"]) if "start" in options else self.places.place(0)
        self.schema = to_arrow_schema(schema)

    def __getstate__(self) -> dict:
        # every task is sent the reader, and needs no row groups but its own
        return {k: v for k, v in self.__dict__.items() if k != "places"}

    def initialOffset(self) -> dict:  # noqa: N802
        return self.start

    def latestOffset(self) -> dict:  # noqa: N802
        from pyarrow import fs

        system, at = located(self.notes)
        known = self.places.ordinal(self.start)
        if system.get_file_info(at).type == fs.FileType.File:
            with system.open_input_stream(at) as f:
                known = max(known, json.loads(f.read())["rows"])
        end = known + (self.rows if self.places.total else 0)
        system.create_dir(at.rpartition("/")[0])
        with system.open_output_stream(f"{at}.new") as f:
            f.write(json.dumps({"rows": end}).encode())
        system.move(f"{at}.new", at)
        return self.places.place(end)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return list(pieces(self.places, self.places.ordinal(start), self.places.ordinal(end)))

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.parquet as pq

        names, at = self.schema.names[len(PLACE) :], 0
        groups, sizes = np.array(partition.groups, "i8").T
        ends = sizes.cumsum()
        with opened(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(row_groups=groups.tolist(), columns=names, batch_size=8192):
                a, b = max(partition.first - at, 0), min(partition.last - at, len(batch))
                if a < b:
                    row = np.arange(at + a, at + b)
                    k = np.searchsorted(ends, row, "right")
                    own = [pa.array(np.full(b - a, x)) for x in (partition.epoch, partition.file)] + [pa.array(groups[k]), pa.array(row - (ends - sizes)[k])]
                    cols = own + [batch.column(n).slice(a, b - a) for n in names]
                    yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(cols, self.schema, strict=True)], schema=self.schema)
                at += len(batch)
                if at >= partition.last:
                    break

    def commit(self, end: dict) -> None:
        pass


class EpochSource(DataSource):
    """Format epochs: groups (JSON), schema (of the files), rows, notes, and start where it doesn't begin at the first row."""

    @classmethod
    def name(cls) -> str:
        return "epochs"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema: StructType) -> EpochReader:  # noqa: N802
        return EpochReader(self.options, schema)


def endless(spark: SparkSession, *paths: str, rows: int, notes: str, start: dict | None = None) -> DataFrame:
    """A stream of epoch, file (ordinal by path), row_group, row, and the files' columns; `rows` more of them a batch.

    notes: a file of this query's own, in a folder that outlives it. start: the place to begin at (a saved one is that of the last row; the next one is
    start). The files' row groups, one line each, are planned by the driver. Files without a row give an empty stream.
    """
    if rows < 1:
        raise ValueError("a batch has one row at least")
    groups = [[r["file"], r["row_group"], r["n_rows"]] for r in row_groups(spark, *paths).orderBy("file", "row_group").collect()]
    fields = spark.read.option("recursiveFileLookup", "true").parquet(*paths).schema.fields
    if {f.name for f in fields} & set(PLACE):
        raise ValueError(f"the files have one of the columns {', '.join(PLACE)}")
    ddl = "epoch long, file long, row_group long, row long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.dataSource.register(EpochSource)
    reader = spark.readStream.format("epochs").option("groups", json.dumps(groups)).option("schema", ddl).option("rows", rows).option("notes", notes)
    return (reader.option("start", json.dumps(start)) if start else reader).load()
