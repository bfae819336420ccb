"""Repeated passages by suffix trees, partitioned by prefixes of variable length.

A passage of `window` words is removed wherever it starts twice or more, in one text or in several.

* Prefixes are counted. Every window holds a sampled position, the least of its `prefix`-word hashes, and equal windows have it at equal
  places. The suffixes that begin with a window are dealt out by the `prefix` words at its sampled position; where these occur only once, all of them are
  leaves and are cut. Where they occur more often than a group may hold, they are lengthened to the whole window.
* Groups are ranges of prefixes, as many as keep one at some MB of text whatever the session's settings are. A group gets the stretches of
  text around its sampled positions, every distinct one once from a blob, with a count, and gives each distinct one's words numbers. Ranks by doubling bring its
  suffixes into their order down to the depth of a window. Suffixes of equal rank are under one node; it is a deep internal node if it has two or more.
* A node tells of its windows whether all are followed, and whether all are preceded, by one and the same word. Windows in a row that
  only occur together are a span: it begins at a left-diverse node and ends at a right-branching one, and repeats as a whole.

Words are compared as they are; hashes only choose prefixes and groups. Texts travel as blobs of some MB, compressed, with all their columns. A blob sends
each distinct prefix and stretch once: a passage that a third of all documents share costs a task one entry a blob, not one a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, materialise

WINDOW, PREFIX = 35, 12
#: Bytes of text in a blob; a longer text is a blob by itself.
BLOB = 2 << 20
#: Occurrences of a prefix that a group may hold; those of more are lengthened.
HEAVY = 100_000
#: Bytes of all texts for each range of prefix counts, and for each group of suffixes.
RANGE, GROUP = 64 << 20, 2 << 20
LEAF, FITS, LONGER = range(3)
#: What a group says of a window.
DEEP, FOLLOWED, PRECEDED = 1, 2, 4
MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 4096), dtype="u8") * np.uint64(2) + np.uint64(1)


def blobs(docs: DataFrame, size: int = BLOB) -> DataFrame:
    """blob, size (bytes of text), data: batches of docs in Arrow's stream format, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(column(batch, "text").cast(pa.large_binary())), 0)).to_numpy()
            a = 0
            while a < batch.num_rows:
                start = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, start + size, "right")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(a, b - a))
                yield {"blob": [made], "size": [int(ends[b - 1] - start)], "data": [sink.getvalue().to_pybytes()]}
                made, a = made + 1, b

    return materialise(map_arrow(docs, run, "blob long, size long, data binary"), "blobs")


def opened(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch()


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, so that one blob is held at a time."""
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def rolled(h: np.ndarray, n: int, row: int = 0) -> np.ndarray:
    """A hash of every n words in a row."""
    out = np.zeros(len(h) - n + 1, "u8")
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * MULTIPLIERS[row, j]
    return mixed(out)


def sampled(p: np.ndarray, n: int) -> np.ndarray:
    """For every n hashes in a row, the place of the least (the last of equals)."""
    least, reach = p.copy(), 1
    while reach < n:
        step = min(reach, n - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    at = np.full(len(least), -1, "i8")
    for j in range(n):
        at = np.where(p[j : j + len(least)] == least, j, at)
    return at + np.arange(len(least))


class Windows:
    """Windows of a blob's texts: for each, its text, its first word and its sampled prefix."""

    def __init__(self, batch: pa.RecordBatch, window: int, prefix: int):
        self.words = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in column(batch, "text")]
        self.window = window
        h = xxhash.xxh64_digest
        #: Runs of windows with one sampled position: text, first window, how many, prefix.
        texts, firsts, counts, keys = [], [], [], []
        for i, w in enumerate(self.words):
            if len(w) >= window:
                p = rolled(np.frombuffer(b"".join(map(h, w)), ">u8").astype("u8"), prefix)
                at = sampled(p, window - prefix + 1)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # a place never comes back once left
                texts.append(np.full(len(first), i))
                firsts.append(first)
                counts.append(np.diff(np.r_[first, len(at)]))
                keys.append(mixed(p[at[first]]))  # the least hashes of windows are small: dealt out evenly once mixed
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.texts, self.firsts, self.counts, self.keys = joined(texts, "i8"), joined(firsts, "i8"), joined(counts, "i8"), joined(keys, "u8")

    def prefixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct sampled prefixes in order, at how many places each is, each run's index)."""
        distinct, where = np.unique(self.keys, return_inverse=True)
        return distinct, np.bincount(where, minlength=len(distinct)), where

    def stretches(self, codes: np.ndarray, groups: int) -> tuple[list[bytes], np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """(distinct stretches by group, how often each occurs, where each group's part begins, (stretch, text, first window) of all).

        codes: of each run's prefix. A stretch is the words of a run's windows between the word before and the word behind; either is empty
        at an end of the text. Of a prefix that is lengthened every window has a stretch of its own.
        """
        number: dict[bytes, int] = {}
        group: list[int] = []
        found, window = [], self.window
        wanted = np.flatnonzero(codes != LEAF)
        for i, a, n, key, code in zip(*(x[wanted].tolist() for x in (self.texts, self.firsts, self.counts, self.keys, codes)), strict=True):
            w = self.words[i]
            for first, many in [(a, n)] if code == FITS else [(a + k, 1) for k in range(n)]:
                end = first + many + window - 1
                own = b" ".join((w[first - 1] if first else b"", *w[first:end], w[end] if end < len(w) else b""))
                at = number.setdefault(own, len(number))
                if at == len(group):
                    inner = key if code == FITS else xxhash.xxh64_intdigest(b" ".join(w[first:end]))
                    group.append(((inner >> 32) * groups) >> 32)
                found.append((at, i, first))
        order = np.argsort(group, kind="stable")
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        times = np.bincount(place[[x[0] for x in found]], minlength=len(order)) if found else np.zeros(0, "i8")
        every = list(number)
        return [every[k] for k in order.tolist()], times, np.array(group, "i8")[order], [(int(place[at]), i, first) for at, i, first in found]


def _cut(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each of ordered 64-bit keys."""
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype("i8")


def _sent(blob: int, at: np.ndarray, times: np.ndarray, part: Callable[[int, int], bytes]) -> dict:
    """A row for each bucket of ordered entries."""
    full, first = np.unique(at, return_index=True)
    cuts = [*first.tolist(), len(at)]
    pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
    return {"blob": np.full(len(full), blob), "bucket": full, "entries": [part(a, b) for a, b in pairs], "times": [times[a:b].astype("u4").tobytes() for a, b in pairs]}


def _answered(sent: DataFrame, answer: Callable[[list[dict]], list[bytes]]) -> DataFrame:
    """blob, parts: answers to the blob's entries by bucket. A task holds one bucket at a time, whatever number of them it gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["bucket"] != rows[0]["bucket"]:
                    yield told(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield told(rows)

    def told(rows: list[dict]) -> dict:
        return {"blob": [r["blob"] for r in rows], "bucket": [r["bucket"] for r in rows], "answer": answer(rows)}

    out = map_arrow(sent.repartition("bucket").sortWithinPartitions("bucket"), run, "blob long, bucket long, answer binary")
    return out.groupBy("blob").agg(F.collect_list(F.struct("bucket", "answer")).alias("parts"))


SENT = "blob long, bucket long, entries binary, times binary"


def _counted(rows: list[dict], heavy: int) -> list[bytes]:
    """Of every prefix, a byte: it is at one place, its suffixes fit into a group, or it must be lengthened."""
    keys = [np.frombuffer(r["entries"], "u8") for r in rows]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    times = np.bincount(where, np.concatenate([np.frombuffer(r["times"], "u4") for r in rows]))
    codes = np.where(times < 2, LEAF, np.where(times > heavy, LONGER, FITS)).astype("u1")[where]
    return [x.tobytes() for x in np.split(codes, np.cumsum([len(k) for k in keys])[:-1])]


def ranks(numbers: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a row of numbers by their first `depth`; for those that have as many."""
    rank, reach = np.unique(numbers, return_inverse=True)[1], 1
    while reach < depth:
        step = min(reach, depth - reach)
        rank = np.unique(rank[:-step] * (len(numbers) + 1) + rank[step:], return_inverse=True)[1]
        reach += step
    return rank


def _nodes(rows: list[dict], window: int) -> list[bytes]:
    """Of every stretch, a byte a window, from the nodes at that depth of the tree over the group's suffixes."""
    number: dict[bytes, int] = {}
    parts = [[number.setdefault(x, len(number)) for x in r["entries"].split(b"\n")] for r in rows]
    times = np.bincount(np.concatenate(parts), np.concatenate([np.frombuffer(r["times"], "u4") for r in rows]))
    words: dict[bytes, int] = {b"": 0}
    sizes = np.fromiter((x.count(b" ") + 1 for x in number), "i8", len(number))
    flat = np.fromiter((words.setdefault(w, len(words)) for x in number for w in x.split(b" ")), "i8", int(sizes.sum()))
    del number, words
    windows = sizes - window - 1
    ends = np.cumsum(windows)
    stretch = np.repeat(np.arange(len(sizes)), windows)
    starts = np.arange(ends[-1]) - (ends - windows)[stretch] + (np.cumsum(sizes) - sizes)[stretch] + 1
    rank = ranks(flat, window)[starts]
    order = np.argsort(rank, kind="stable")
    first = np.flatnonzero(np.diff(rank[order], prepend=-1))
    node = np.empty(len(order), "i8")
    node[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    said = np.where(np.add.reduceat(times[stretch[order]], first) > 1, DEEP, 0)
    for beside, bit in ((flat[starts + window], FOLLOWED), (flat[starts - 1], PRECEDED)):
        least = np.minimum.reduceat(beside[order], first)
        said |= np.where((least > 0) & (least == np.maximum.reduceat(beside[order], first)), bit, 0)
    flags = said.astype("u1")[node].tobytes()
    own = [flags[b - n : b] for b, n in zip(ends.tolist(), windows.tolist(), strict=True)]
    return [b"".join([own[k] for k in part]) for part in parts]


def _told(parts: list[dict] | None) -> np.ndarray:
    """Answers to all of a blob's entries, which are ordered by bucket."""
    return np.frombuffer(b"".join(p["answer"] for p in sorted(parts or [], key=lambda p: p["bucket"])), "u1")


def repeated_passages(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, clean: bool = False, heavy: int = HEAVY, group: int = GROUP) -> DataFrame:
    """Each row's repeated passages.

    doc_id, n_words, n_removed, kept_sha256, spans (first and last word of passages that repeat as a whole: the longest runs of windows
    that have all their occurrences in common; spans overlap where a part of one occurs elsewhere too); or, with clean, the
    columns of docs with the kept words, joined by one space, as text. Texts without a repeat are left as they are then.
    A null or empty text has no words and stays; repeated rows are texts of their own, so all their windows repeat; columns of other names
    pass through with clean; without rows there are none. A task holds a blob, or a group: prefixes that occur `heavy` times at most, of about `group` bytes of
    all texts, each distinct stretch once.
    """
    if not 0 < prefix <= window:
        raise ValueError("prefix must be within the window")
    table = blobs(docs if clean else docs.select("doc_id", "text"))
    size = table.agg(F.sum("size")).first()[0] or 0
    ranges, groups = 1 + size // RANGE, 1 + size // group
    table = table.drop("size")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in _each(batch):
                keys, times, _ = Windows(opened(row["data"]), window, prefix).prefixes()
                yield _sent(row["blob"], _cut(keys, ranges), times, lambda a, b, keys=keys: keys[a:b].tobytes())

    level1 = materialise(_answered(map_arrow(table, first, SENT), lambda rows: _counted(rows, heavy)), "prefixes")

    def wanted(row: dict) -> tuple[pa.RecordBatch, Windows, tuple]:
        batch = opened(row["data"])
        w = Windows(batch, window, prefix)
        _, _, where = w.prefixes()
        return batch, w, w.stretches(_told(row["parts1"])[where], groups)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in _each(batch):
                every, times, at, _ = wanted(row)[2]
                yield _sent(row["blob"], at, times, lambda a, b, every=every: b"\n".join(every[a:b]))

    # merged at every size: what the answers need grows with the input, so they are never broadcast
    half = table.hint("merge").join(level1.withColumnRenamed("parts", "parts1"), "blob", "left")
    level2 = materialise(_answered(map_arrow(half, second, SENT), lambda rows: _nodes(rows, window)), "nodes")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows in batches:
            for row in _each(rows):
                batch, w, (every, _, _, found) = wanted(row)
                told = _told(row["parts2"])
                ends = np.cumsum([x.count(b" ") - window for x in every])
                said: dict[int, np.ndarray] = {}
                for k, i, a in found:
                    own = told[ends[k - 1] if k else 0 : ends[k]]
                    said.setdefault(i, np.zeros(len(w.words[i]) - window + 1, "u1"))[a : a + len(own)] = own
                covers: dict[int, np.ndarray] = {}
                for i, flags in said.items():
                    starts = np.flatnonzero(flags & DEEP)
                    if len(starts):
                        edge = np.zeros(len(w.words[i]) + 1, "i4")
                        edge[starts] += 1
                        edge[starts + window] -= 1
                        covers[i] = np.cumsum(edge[:-1]) > 0
                if clean:
                    texts = column(batch, "text").to_pylist()
                    for i, gone in covers.items():
                        texts[i] = b" ".join([x for x, g in zip(w.words[i], gone.tolist(), strict=True) if not g]).decode("utf-8", "surrogatepass")
                    yield {c: column(batch, c) for c in batch.schema.names} | {"text": texts} | ({"n_chars": [None if t is None else len(t) for t in texts]} if "n_chars" in batch.schema.names else {})
                    continue
                removed, sha, spans = [], [], []
                for i, words in enumerate(w.words):
                    gone = covers.get(i)
                    removed.append(0 if gone is None else int(gone.sum()))
                    sha.append(hashlib.sha256(b" ".join(words if gone is None else [x for x, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
                    if gone is None:
                        spans.append([])
                        continue
                    starts, flags = np.flatnonzero(said[i] & DEEP), said[i]
                    # the next window goes on with this one if neither occurs without the other
                    on = (np.diff(starts) == 1) & (flags[starts[:-1]] & FOLLOWED > 0) & (flags[starts[1:]] & PRECEDED > 0)
                    spans.append([{"first": int(a), "last": int(b) + window - 1} for a, b in zip(starts[np.r_[True, ~on]], starts[np.r_[~on, True]], strict=True)])
                yield {"doc_id": column(batch, "doc_id"), "n_words": list(map(len, w.words)), "n_removed": removed, "kept_sha256": sha, "spans": spans}

    both = half.hint("merge").join(level2.withColumnRenamed("parts", "parts2"), "blob", "left")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) if clean else "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,last:int>>"
    return map_arrow(both, last, ddl)
