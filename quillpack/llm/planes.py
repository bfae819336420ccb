"""Token ids in bit- or byte-plane files.

A file is a Parquet table of segments, written by Spark's own committer, so a lost task leaves nothing behind. A
segment holds whole documents in ascending doc_id order: ids are cut into blocks of a fixed size, each block is
transposed into planes (plane k has bit or byte k of every id), each plane is compressed with zstandard, and the
payload is the planes in a row. The chunk index has each block's first id, number of ids and the planes' sizes (0: a plane of zeros).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, scratch
from .tokens import encoded

#: Ids in a block, ids in a segment (a longer document has a segment to itself).
BLOCK, SEGMENT = 1 << 14, 1 << 20
SEGMENTS = "shard int, segment int, first long, n_ids long, width int, doc_ids array<long>, lengths array<long>, index array<struct<first:long,n:int,sizes:array<int>>>, payload binary"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first: 32 of bits, or 4 of bytes."""
    rows = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [rows[:, k].tobytes() for k in range(4)]
    flat = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(flat[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    bits = len(planes) == 32
    out = np.zeros((n, 32 if bits else 4), np.uint8)
    for k, p in enumerate(planes):
        if p:
            out[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n) if bits else np.frombuffer(p, np.uint8)
    return (np.packbits(out, axis=1, bitorder="little") if bits else out).view("<u4").ravel()


def encode_blocks(ids: np.ndarray, block: int, bits: bool) -> tuple[list[dict], bytes]:
    """(chunk index, payload) of a run of ids."""
    press, index, out = zstandard.ZstdCompressor(level=3), [], []
    for a in range(0, len(ids), block):
        part = ids[a : a + block]
        packed = [press.compress(p) if p.strip(b"\0") else b"" for p in to_planes(part, bits)]
        index.append({"first": a, "n": len(part), "sizes": list(map(len, packed))})
        out += packed
    return index, b"".join(out)


def decode_blocks(index: list[dict], payload: bytes) -> np.ndarray:
    """All ids of a segment; one block alone is found by its entry's sizes."""
    press, out, at = zstandard.ZstdDecompressor(), [], 0
    for block in index:
        planes = []
        for size in block["sizes"]:
            planes.append(press.decompress(payload[at : at + size]) if size else b"")
            at += size
        out.append(from_planes(planes, block["n"]))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, bits: bool = False, block: int = BLOCK, segment: int = SEGMENT) -> None:
    """Encode doc_id, text and write the ids, end_id behind each document, as shards in ascending order of doc_id.

    Only the texts are dealt out, once, by ranges of doc_id; a task holds the ids of one segment. A null text is empty;
    a null doc_id comes first; repeated rows stay, each a document of its own. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shard, made, first, total = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[np.ndarray] = []
        docs_in: list[int] = []
        lengths: list[int] = []

        def flush() -> dict:
            index, payload = encode_blocks(np.concatenate(ids), block, bits)
            return {"shard": [shard], "segment": [made], "first": [first], "n_ids": [total], "width": [32 if bits else 4], "doc_ids": [docs_in], "lengths": [lengths], "index": [index], "payload": [payload]}

        for batch in batches:
            keys = column(batch, "doc_id")
            for a, rows, flat, counts in encoded(batch, tokenizer, end_id):
                own, counts = keys.slice(a, rows).to_pylist(), counts.tolist()
                begin = at = i = 0
                for k, n in enumerate(counts):
                    if total and total + n > segment:
                        ids.append(flat[begin:at])
                        docs_in, lengths = docs_in + own[i:k], lengths + counts[i:k]
                        yield flush()
                        made, first, total = made + 1, first + total, 0
                        ids, docs_in, lengths, begin, i = [], [], [], at, k
                    at += n
                    total += n
                ids.append(flat[begin:])
                docs_in, lengths = docs_in + own[i:], lengths + counts[i:]
        if lengths:
            yield flush()

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(rows, run, SEGMENTS).write.parquet(path)


def read_ids(df: DataFrame) -> DataFrame:
    """doc_id, shard, offset in the shard, n_tokens and ids (little-endian 32-bit) of each document of a written table."""
    return _read(df, lambda ids: ids, "ids binary")


def _read(df: DataFrame, digest, ddl: str) -> DataFrame:
    name = ddl.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = memoryview(decode_blocks(row["index"], row["payload"]).tobytes())
                ends = np.cumsum([0, *row["lengths"]])
                yield {"doc_id": row["doc_ids"], "shard": [row["shard"]] * len(row["doc_ids"]), "offset": row["first"] + ends[:-1], "n_tokens": row["lengths"], name: [digest(ids[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]}

    return map_arrow(df.select("shard", "first", "doc_ids", "lengths", "index", "payload"), run, "doc_id long, shard int, offset long, n_tokens long, " + ddl)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, bits: bool = False) -> DataFrame:
    """Write docs' ids, read the files back: doc_id, start, n_tokens, ids_crc32, shard."""
    path = scratch(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer, end_id, bits)
    files = docs.sparkSession.read.parquet(path)
    # One row a shard, as many as the write had tasks; that bounds the broadcast (16 bytes a task).
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    rows = _read(files, zlib.crc32, "ids_crc32 long")
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "shard")
