"""Collated packs, written together with the positions that their samples were read at.

A step is a folder named by its number in seven digits, with the packs, the positions and, last of all, a list of both. Tasks write their packs into a
folder beside it and hand their files and positions to the driver as commit messages; the driver puts the positions with them and moves the
whole folder. A step that has no list isn't there: a failed task, or a failed commit, leaves neither packs nor positions to be read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .scratch import located

DONE = "_LIST"


def padded_image(image: Column, channels: Column, height: Column, width: Column) -> Column:
    """An image (c, h, w, data: channel by channel, row by row) with zeros to its right and below, and behind its channels, as an array."""
    size = (channels * height * width).cast("int")

    def pixel(i: Column) -> Column:
        c, y, x = F.floor(i / (height * width)), F.floor(i / width) % height, i % width
        inside = (c < image["c"]) & (y < image["h"]) & (x < image["w"])
        return F.when(inside, F.get(image["data"], ((c * image["h"] + y) * image["w"] + x).cast("int"))).otherwise(F.lit(0))

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), pixel)).otherwise(F.array().cast("array<double>"))


def collated(samples: DataFrame, keys: list[str], place: str, most: int, joined: list[str] = [], shifted: list[str] = [], images: str | None = None) -> DataFrame:  # noqa: B006
    """One row a pack: keys, sequence_length, sample_lens, split_lens, attn_modes, the arrays of `joined` and `shifted`, images and positions.

    samples: keys, place (their order in the pack), length, split_lens, attn_modes, dataset, position (an array of numbers), and arrays: those of `joined`
    are put one behind the other, those of `shifted` hold places in a sample and become places in the pack. A pack of no more than `most` tokens ends with a
    sample and a full split of what is missing, which may be nothing; a longer one is left as it is. images: an array of (c, h, w, data) by sample; all of a
    pack's are padded with zeros to its largest channels, height and width, flat in padded_images, their common shape in image_shape. positions: the place of the
    last sample of each dataset. A pack's samples meet in one task: no more than a pack holds.
    """
    names = ["length", "split_lens", "attn_modes", "dataset", "position", *joined, *shifted, *([images] if images else [])]
    packs = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(place, *names))).alias("s"))
    lengths = F.transform("s", lambda x: x["length"].cast("long"))
    starts = F.transform("s", lambda x, i: F.aggregate(F.slice("s", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["length"]))
    packs = packs.select(*keys, "s", lengths.alias("lens"), starts.alias("starts"), F.aggregate("s", F.lit(0).cast("long"), lambda a, y: a + y["length"]).alias("sequence_length"))
    pad = F.when(F.col("sequence_length") <= most, F.array(most - F.col("sequence_length"))).otherwise(F.array().cast("array<long>"))
    flat = lambda c: F.flatten(F.transform("s", lambda x: F.coalesce(x[c], F.array())))
    moved = lambda c: F.flatten(F.zip_with("s", "starts", lambda x, a: F.transform(F.coalesce(x[c], F.array()), lambda v: v + a)))
    # in order of place, the last of a dataset wins
    datasets = F.array_distinct(F.transform("s", lambda x: x["dataset"]))
    positions = F.map_from_entries(F.transform(datasets, lambda d: F.struct(d, F.element_at(F.filter("s", lambda x: x["dataset"] == d), -1)["position"])))
    out = [
        *keys, "sequence_length", F.concat("lens", pad).alias("sample_lens"), F.concat(F.transform(flat("split_lens"), lambda x: x.cast("long")), pad).alias("split_lens"),
        F.concat(flat("attn_modes"), F.transform(pad, lambda _: F.lit("full"))).alias("attn_modes"), *(flat(c).alias(c) for c in joined), *(moved(c).alias(c) for c in shifted), positions.alias("positions"),
    ]
    if not images:
        return packs.select(*out)
    packs = packs.select(*out, flat(images).alias("i"))
    largest = F.struct(*(F.coalesce(F.array_max(F.col(f"i.{d}")), F.lit(0)).cast("long").alias(d) for d in "chw"))
    packs = packs.withColumn("image_shape", largest)
    shape = [F.col(f"image_shape.{d}") for d in "chw"]
    return packs.withColumn("padded_images", F.flatten(F.transform("i", lambda x: padded_image(x, *shape)))).drop("i")


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    positions: list


class PackWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.step, self.keys = options["path"].rstrip("/"), int(options["step"]), options["keys"].split(",")
        self.pending = f"{self.path}/_pending-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        system, at = located(self.pending)
        system.create_dir(f"{at}/packs")
        name, writer, last = f"{uuid.uuid4().hex}.parquet", None, {}
        try:
            for batch in batches:
                if not len(batch):
                    continue
                if writer is None:
                    writer = pq.ParquetWriter(f"{at}/packs/{name}", batch.schema, filesystem=system)
                writer.write_batch(batch)
                for r in batch.select([*self.keys, "positions"]).to_pylist():
                    # the last key tells the packs of a reader apart, in order
                    *reader, pack = (r[k] for k in self.keys)
                    for dataset, position in r["positions"] or []:
                        key = (*reader, dataset)
                        last[key] = max(last.get(key, (-1, [])), (pack, position))
        finally:
            if writer is not None:
                writer.close()
        return Written(name if writer is not None else None, [[list(k), *v] for k, v in last.items()])

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, at = located(self.pending)
        names, last = set(), {}
        for m in messages:
            if m is not None and m.name:
                names.add(m.name)
                for key, pack, position in m.positions:
                    last[tuple(key)] = max(last.get(tuple(key), (-1, [])), (pack, position))
        system.create_dir(f"{at}/packs")
        # attempts that another one took the place of
        for f in system.get_file_info(fs.FileSelector(f"{at}/packs")):
            if f.base_name not in names:
                system.delete_file(f.path)
        positions = [{"reader": [str(x) for x in k[:-1]], "dataset": k[-1], "position": p} for k, (_, p) in sorted(last.items(), key=str)]
        done = f"{located(self.path)[1]}/{self.step:07d}"
        if system.get_file_info(done).type != fs.FileType.NotFound:
            if system.get_file_info(f"{done}/{DONE}").type == fs.FileType.File:
                raise FileExistsError(f"step {self.step} is written")
            system.delete_dir(done)
        system.move(at, done)
        for name, rows in (("positions.json", positions), (DONE, [sorted(names)])):
            with system.open_output_stream(f"{done}/{name}") as f:
                f.write("".join(json.dumps(r) + "\n" for r in rows).encode())

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, at = located(self.pending)
        if system.get_file_info(at).type != fs.FileType.NotFound:
            system.delete_dir(at)


class PackSink(DataSource):
    """Format packs: path, step, keys."""

    @classmethod
    def name(cls) -> str:
        return "packs"

    def writer(self, schema: StructType, overwrite: bool) -> PackWriter:
        return PackWriter(self.options)


def write_collated(packs: DataFrame, path: str, step: int, keys: list[str]) -> None:
    """collated() packs and their readers' positions as one step; keys name the reader, the last one its packs in order. A written step stays."""
    packs.sparkSession.dataSource.register(PackSink)
    packs.write.format("packs").mode("append").option("step", step).option("keys", ",".join(keys)).save(path)


def steps(spark: SparkSession, path: str) -> list[int]:
    """The steps that are there as a whole."""
    from pyarrow import fs

    system, at = located(path)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(int(f.base_name) for f in found if f.base_name.isdigit() and system.get_file_info(f"{f.path}/{DONE}").type == fs.FileType.File)


def read_collated(spark: SparkSession, path: str, step: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(packs, positions: reader, dataset, position) of a step, of the latest without one; None where it isn't there. A step without packs gives None too."""
    from pyarrow import fs

    known = steps(spark, path)
    step = step if step is not None else (known[-1] if known else None)
    if step not in known:
        return None
    at = f"{path.rstrip('/')}/{step:07d}"
    system, folder = located(f"{at}/packs")
    if not system.get_file_info(fs.FileSelector(folder)):
        return None
    return spark.read.parquet(f"{at}/packs"), spark.read.schema("reader array<string>, dataset string, position array<long>").json(f"{at}/positions.json")
