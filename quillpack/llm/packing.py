"""Mixture-controlled packing: deficit round-robin over source queues.

Each window of 2048 tokens is filled from one queue per source. A round adds to every queue's deficit its share of a
window and serves packets while the deficit is positive; what a packet overdraws is carried to the next window, and
from bundle to bundle, whatever tasks pack them. The packets of a window thus keep target proportions up to one packet a source, at
every prefix of the output.

Documents are encoded where they are read, in blobs. The queue of a source is its documents in the order of tasks, blobs and rows,
so the counts of blobs place every id in its queue. The output is cut into bundles of BUNDLE ids, and what a
bundle holds of each queue is what its targets give up to there: sources advance at the rate of their shares until they end, and
sources without a share follow when all others have ended. Blobs are cut behind the packet that reaches such a place and their cuts
dealt to the bundles, whatever order or files the input has; documents that cross a cut go on in the next bundle.
The packet at a cut is served before it is due. By how much is the deficit that its source enters the next bundle with: what the targets give it
in all earlier bundles, less the place in its queue where the bundle's first packet of it lies. Both are sums over all bundles before, so bundles
are packed side by side with the deficits that one pass over all of them would carry. Windows are full; a bundle's rest is cut into sequences whose lengths are powers of two,
which need no padding. All ids are packed, so a target that differs from the corpus' own proportions holds as long as each source lasts.
The driver and each task hold a row for each source.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, materialise
from .tokens import encoded

WINDOW, GRAIN = 2048, 512
#: Ids in a bundle, and in a blob, where a longer document is one by itself.
BUNDLE, BLOB = 1 << 21, 1 << 17
#: Ids in one cut that is dealt, up to a packet.
CUT = 1 << 17
BUNDLES = "task int, bundle int, doc_ids array<long>, sources array<string>, lengths array<long>, before array<struct<source:string,n:long>>, wide boolean, ids binary"
CUTS = "target long, source string, at long, doc_ids array<long>, starts array<long>, lengths array<long>, doc_tokens array<long>, wide boolean, ids binary"
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length int"
#: Tasks that bundles are dealt to at most; a task packs one bundle after the other.
MOST_TASKS = 20_000
#: Rows of the carried deficits that may be broadcast.
CARRY_ROWS = 100_000


def bundles(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = BLOB) -> DataFrame:
    """Documents' ids, end_id behind each, as blobs of about size ids; before: ids of each source earlier in the task. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        task, made, total = TaskContext.get().partitionId(), 0, 0
        before: dict[str | None, int] = {}
        ids: list[np.ndarray] = []
        keys: list[int] = []
        sources: list[str | None] = []
        lengths: list[int] = []

        def flush() -> dict:
            flat = np.concatenate(ids)
            wide = bool(len(flat) and flat.max() > 0xFFFF)
            earlier = [{"source": s, "n": n} for s, n in before.items()]
            out = {"task": [task], "bundle": [made], "doc_ids": [keys], "sources": [sources], "lengths": [lengths], "before": [earlier], "wide": [wide], "ids": [(flat if wide else flat.astype("<u2")).tobytes()]}
            for s, n in zip(sources, lengths, strict=True):
                before[s] = before.get(s, 0) + n
            return out

        for batch in batches:
            for a, rows, flat, counts in encoded(batch, tokenizer, end_id):
                own, origin, counts = (x.to_pylist() if isinstance(x, pa.Array) else x.tolist() for x in (column(batch, "doc_id").slice(a, rows), column(batch, "source").slice(a, rows), counts))
                begin = at = i = 0
                for k, n in enumerate(counts):
                    if total and total + n > size:
                        ids.append(flat[begin:at])
                        keys, sources, lengths = keys + own[i:k], sources + origin[i:k], lengths + counts[i:k]
                        yield flush()
                        made, total, ids, keys, sources, lengths, begin, i = made + 1, 0, [], [], [], [], at, k
                    at += n
                    total += n
                ids.append(flat[begin:])
                keys, sources, lengths = keys + own[i:], sources + origin[i:], lengths + counts[i:]
        if lengths:
            yield flush()

    return materialise(map_arrow(docs.select("doc_id", "source", "text"), run, BUNDLES), "bundles")


def schedule(sources: list[str | None], lengths: list[int], share: dict[str | None, float], deficit: dict[str | None, float], window: int = WINDOW, grain: int = GRAIN) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset, length of the sequence) of one bundle."""
    queues: dict[str | None, list[int]] = {}
    for i, s in enumerate(sources):
        queues.setdefault(s, []).append(i)
    ring = sorted(queues, key=lambda s: (s is not None, s or ""))
    for q in queues.values():
        q.reverse()
    owed = {s: deficit.get(s, 0.0) for s in ring}
    left = sum(lengths)
    done = [0] * len(lengths)
    sequence = turn = 0
    while left:
        room = size = window if left >= window else 1 << (left.bit_length() - 1)
        offset = 0
        pieces: list[list[int]] = []
        while room:
            if turn >= len(ring):
                turn = 0
            s = ring[turn]
            q = queues[s]
            while room and owed[s] > 0:
                i = q[-1]
                n = min(grain, lengths[i] - done[i], room)
                if pieces and pieces[-1][0] == i and pieces[-1][1] + pieces[-1][2] == done[i]:
                    pieces[-1][2] += n
                else:
                    pieces.append([i, done[i], n, offset])
                done[i] += n
                offset += n
                room -= n
                owed[s] -= n
                if done[i] == lengths[i]:
                    q.pop()
                    if not q:
                        break
            if not q:
                del ring[turn], owed[s]
                if not ring:
                    break
                continue
            if room:
                turn += 1
                if turn >= len(ring):
                    turn = 0
                    total = sum(share.get(x, 0.0) for x in ring)
                    each = 1 / len(ring)
                    # rounds in which no deficit would turn positive are taken at once
                    gain = {x: window * (share.get(x, 0.0) / total if total > 0 else each) for x in ring}
                    wait = min((-owed[x] / gain[x] for x in ring if gain[x] > 0))
                    times = max(1, int(wait) + 1)
                    for x in ring:
                        owed[x] += times * gain[x]
        for i, start, n, at in pieces:
            yield i, start, n, sequence, at, size
        left -= size
        sequence += 1


def rates(held: dict[str, int], target: dict[str, float] | None, size: int) -> tuple[dict[str, float], dict[str, float], np.ndarray]:
    """Each source's rate and start, and the times at which bundles of size ids are full; the last is endless.

    By a time t a source of n ids has given min(n, rate * (t - start)). held: ids of each source.
    """
    if not held:
        return {}, {}, np.array([np.inf])
    share = {s: float(n) for s, n in held.items()} if target is None else {s: max(0.0, target.get(s, 0.0)) for s in held}
    total = sum(share.values())
    rate = {s: x / total for s, x in share.items() if x > 0}
    last = max((held[s] / rate[s] for s in rate), default=0.0)
    start = {s: 0.0 if s in rate else last for s in held}
    rate = {s: rate.get(s, 1.0) for s in held}
    when = np.array([[*start.values()], [start[s] + n / rate[s] for s, n in held.items()]]).ravel()
    turn = np.array([[*rate.values()], [-x for x in rate.values()]]).ravel()
    order = np.argsort(when, kind="stable")
    when, slope = when[order], turn[order].cumsum()
    given = np.r_[0.0, (slope[:-1] * np.diff(when)).cumsum()]
    count = -(-sum(held.values()) // size)
    return rate, start, np.r_[np.interp(np.arange(1, count) * float(size), given, when), np.inf]


def due(n: float, rate: float, start: float, times: np.ndarray | float) -> np.ndarray:
    """What a source of n ids has been given by the times: where its queue is cut."""
    return np.minimum(float(n), rate * np.maximum(0.0, np.asarray(times) - start)).astype("i8")


def carried(source: str | None, at: int, bundle: int, held: dict[str, int], rate: dict[str, float], start: dict[str, float], times: np.ndarray) -> float:
    """The deficit of a source whose first packet in a bundle lies at a place of its queue; 0 or less, above minus one packet."""
    return float(due(held[source], rate[source], start[source], times[bundle - 1]) - at) if bundle else 0.0


def cuts(made: DataFrame, held: dict[str, int], rate: dict[str, float], start: dict[str, float], times: np.ndarray, grain: int) -> DataFrame:
    """Blobs (with served, the ids of each source in earlier tasks) cut by source and bundle; at: the place in the source's queue.

    A packet, a document's next grain ids, is whole and in the bundle in which it begins to be due.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in itertools.chain.from_iterable(map(as_rows, batches)):
            served, before = ({x["source"]: x["n"] for x in row[c]} for c in ("served", "before"))
            flat = np.frombuffer(row["ids"], "<u4" if row["wide"] else "<u2")
            lengths = np.array(row["lengths"], "i8")
            begins = lengths.cumsum() - lengths
            queues: dict[str | None, list[int]] = {}
            for i, s in enumerate(row["sources"]):
                queues.setdefault(s, []).append(i)
            for s, queue in queues.items():
                ends = due(held[s], rate[s], start[s], times)
                at = served[s] + before.get(s, 0)
                made_at, out, size = at, [], 0
                k = int(np.searchsorted(ends, at, "right"))
                for i in queue:
                    done, n = 0, int(lengths[i])
                    while done < n:
                        room = min(int(ends[k]) - at, CUT - size)
                        take = min(n - done, -(-room // grain) * grain)
                        out.append((row["doc_ids"][i], done, take, n, int(begins[i]) + done))
                        done, at, size = done + take, at + take, size + take
                        if at >= ends[k] or size >= CUT:
                            yield packet(k, s, made_at, out, flat, row["wide"])
                            made_at, out, size = at, [], 0
                            if at >= ends[k]:
                                k = int(np.searchsorted(ends, at, "right"))
                if out:
                    yield packet(k, s, made_at, out, flat, row["wide"])

    def packet(k: int, s: str, at: int, out: list[tuple], flat: np.ndarray, wide: bool) -> dict:
        keys, starts, lengths, tokens, begins = map(list, zip(*out, strict=True))
        ids = np.concatenate([flat[b : b + n] for b, n in zip(begins, lengths, strict=True)]).tobytes()
        return {"target": [k], "source": [s], "at": [at], "doc_ids": [keys], "starts": [starts], "lengths": [lengths], "doc_tokens": [tokens], "wide": [wide], "ids": [ids]}

    return map_arrow(made.select("doc_ids", "sources", "lengths", "before", "wide", "ids", "served"), run, CUTS)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, target: dict[str, float] | None = None, window: int = WINDOW, grain: int = GRAIN, size: int = BUNDLE) -> DataFrame:
    """Pieces of all documents; sequence_id is in the order of the output. target: weights of sources; by default each source's part of all tokens.

    A null text is empty (its end id alone is packed), a null source is a source of its own, repeated rows are
    documents of their own, an empty table has no pieces, other columns are left out. A source that has served more than it was due enters
    the next bundle with that deficit.
    """
    made = bundles(docs, tokenizer, end_id)
    own = made.select("task", F.explode(F.arrays_zip("sources", "lengths")).alias("x")).groupBy("task", F.col("x.sources").alias("source")).agg(F.sum("x.lengths").alias("n"))
    own = materialise(own, "held")
    held = {r["source"]: r["n"] for r in own.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").collect()}
    rate, start, times = rates(held, target, max(1, size // window) * window)
    carry = own.select("task", "source", (F.sum("n").over(Window.partitionBy("source").orderBy("task")) - F.col("n")).alias("served"))
    carry = materialise(carry.groupBy("task").agg(F.collect_list(F.struct("source", F.col("served").alias("n"))).alias("served")), "carry")
    carry = F.broadcast(carry) if own.count() <= CARRY_ROWS else carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = itertools.chain.from_iterable(map(as_rows, batches))
        for bundle, packets in itertools.groupby(rows, lambda row: row["target"]):
            sources: list[str | None] = []
            keys: list[int] = []
            begins: list[int] = []
            lengths: list[int] = []
            tokens: list[int] = []
            flat: list[bytes] = []
            deficit: dict[str | None, float] = {}
            for row in packets:
                if row["source"] not in deficit:
                    deficit[row["source"]] = carried(row["source"], row["at"], bundle, held, rate, start, times)
                sources += [row["source"]] * len(row["doc_ids"])
                keys += row["doc_ids"]
                begins += row["starts"]
                lengths += row["lengths"]
                tokens += row["doc_tokens"]
                flat.append(np.frombuffer(row["ids"], "<u4" if row["wide"] else "<u2").astype("<u4").tobytes())
            ids = memoryview(b"".join(flat))
            starts = np.cumsum([0, *lengths]).tolist()
            share = {s: rate[s] for s in set(sources) if not start[s]}
            doc, first, length, sequence, offset, full = map(list, zip(*schedule(sources, lengths, share, deficit, window, grain), strict=True))
            yield {
                "doc_id": [keys[i] for i in doc], "source": [sources[i] for i in doc], "start": [begins[i] + a for i, a in zip(doc, first, strict=True)], "length": length,
                "ids_crc32": [zlib.crc32(ids[4 * (starts[i] + a) : 4 * (starts[i] + a + n)]) for i, a, n in zip(doc, first, length, strict=True)],
                "doc_tokens": [tokens[i] for i in doc], "sequence_id": [(bundle << 24) + k for k in sequence], "offset": offset, "sequence_length": full,
            }

    dealt = cuts(made.join(carry, "task"), held, rate, start, times, grain)
    # tasks of some bundles each, whatever the size of the input
    tasks = min(MOST_TASKS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(times) // 8))
    return map_arrow(dealt.repartition(tasks, "target").sortWithinPartitions("target", "source", "at"), run, PIECES)


def as_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One at a time."""
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]
