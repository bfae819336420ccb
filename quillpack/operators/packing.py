"""Greedy packing of samples into token budgets, one packer for each (rank, worker).

Rows are dealt by packer and sorted by reading order; a task streams over them with the state of one packer (cursor, buffer of at
most `capacity` samples), so that no group is ever held as a whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """target: a pack ends at or above it; most: it never starts a sample that would pass it; sample: longer ones are left out;
    prefer: below it buffered samples come first; capacity: samples in the buffer."""

    target: int = 32768
    most: int = 36864
    sample: int = 16384
    prefer: int = 16384
    capacity: int = 50


@dataclass
class Packer:
    """The state of one packer. feed() takes a sample and yields what became of samples: (seq, pack, place, status)."""

    limits: Limits
    mandatory: tuple[str, ...] = ()
    pack: int = 0
    cursor: int = 0
    place: int = 0
    buffer: deque = field(default_factory=deque)
    waiting: dict = field(default_factory=dict)
    queue: deque = field(default_factory=deque)

    def _put(self, seq: int, length: int) -> tuple:
        out = (seq, self.pack, self.place, "packed")
        self.cursor += length
        self.place += 1
        return out

    def _flush(self) -> None:
        self.pack, self.cursor, self.place = self.pack + 1, 0, 0

    def feed(self, seq: int, group: str, est: int, length: int) -> Iterator[tuple]:
        if group in self.mandatory:
            self.waiting.setdefault(group, deque()).append((seq, est, length))
        else:
            self.queue.append((seq, est, length))
        yield from self._run(False)

    def end(self) -> Iterator[tuple]:
        """At the end of the input: what can still be packed is, the rest is reported as left."""
        yield from self._run(True)
        for seq, _, _ in [*self.buffer, *self.queue, *(x for q in self.waiting.values() for x in q)]:
            yield seq, None, None, "left"

    def _run(self, ended: bool) -> Iterator[tuple]:
        m = self.limits
        while True:
            if self.cursor == 0 and self.place == 0 and self.mandatory:
                for g in self.mandatory:
                    q = self.waiting.setdefault(g, deque())
                    while q and q[0][1] >= m.sample:
                        yield q.popleft()[0], None, None, "too long"
                    if not q:
                        return
                for g in self.mandatory:
                    seq, _, length = self.waiting[g].popleft()
                    yield self._put(seq, length)
            if self.cursor < m.prefer and self.buffer:
                (seq, est, length), from_buffer = self.buffer.popleft(), True
            elif self.queue:
                (seq, est, length), from_buffer = self.queue.popleft(), False
            else:
                return
            if est > m.sample:
                yield seq, None, None, "too long"
            elif self.cursor + est > m.most:
                if not from_buffer and len(self.buffer) < m.capacity:
                    self.buffer.append((seq, est, length))
                else:
                    self._flush()
                    yield seq, None, None, "dropped at flush"
            else:
                yield self._put(seq, length)
                if self.cursor >= m.target:
                    self._flush()


def pack(samples: DataFrame, limits: Limits = Limits(), mandatory: tuple[str, ...] = (), keys: tuple[str, str] = ("rank", "worker")) -> DataFrame:
    """rank, worker, seq, pack, place, status for samples (rank, worker, seq, group, est, length).

    status: packed, too long, dropped at flush (a sample that overflows while the buffer is full ends the pack and is
    lost), or left in the buffer at the end. A sample of every mandatory group opens each pack, and must be under the
    sample limit; others may reach it. Only one shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = dict(samples.dtypes)
    ddl = f"{keys[0]} {kinds[keys[0]]}, {keys[1]} {kinds[keys[1]]}, seq long, pack long, place int, status string"
    empty = samples.sparkSession.createDataFrame([], ddl)
    schema = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, now, out = None, None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                key = (r[keys[0]], r[keys[1]])
                if key != now or packer is None:
                    if packer is not None:
                        out += [(*now, *x) for x in packer.end()]
                    packer, now = Packer(limits, mandatory), key
                out += [(*now, *x) for x in packer.feed(r["seq"], r["group"], r["est"], r["length"])]
            yield made()
            out = []
        if packer is not None:
            out += [(*now, *x) for x in packer.end()]
            yield made()

    rows = samples.select(*keys, "seq", "group", "est", "length").repartition(*keys).sortWithinPartitions(*keys, "seq")
    return rows.mapInArrow(run, ddl)


def next_fit(samples: DataFrame, most: int, sample: int | None = None) -> DataFrame:
    """rank, worker, seq, est, pack: without buffer; a sample that doesn't fit opens the next pack; samples over `sample` are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = dict(samples.dtypes)
    ddl = f"rank {kinds['rank']}, worker {kinds['worker']}, seq long, est long, pack long"
    schema = to_arrow_schema(samples.sparkSession.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cursor, number = None, 0, 0
        for batch in batches:
            packs = []
            for rank, worker, est in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("rank", "worker", "est")), strict=True):
                if (rank, worker) != now:
                    now, cursor, number = (rank, worker), 0, 0
                elif cursor + est > most:
                    cursor, number = 0, number + 1
                cursor += est
                packs.append(number)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)).cast(schema.field(c).type) for c in ("rank", "worker", "seq", "est")), pa.array(packs, pa.int64())], schema=schema)

    rows = samples.where(F.col("est") <= (sample or most)).select("rank", "worker", "seq", F.col("est").cast("long").alias("est"))
    return rows.repartition("rank", "worker").sortWithinPartitions("rank", "worker", "seq").mapInArrow(run, ddl)
