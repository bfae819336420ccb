"""Packing of a stream of samples with exactly-once state: next-fit, and the whole packer."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..operators.packing import Limits, Packer

OUT = "packer string, seq long, est long, pack long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_packs(samples: DataFrame, most: int) -> DataFrame:
    """packer, seq, est, pack for a stream of (packer, seq, est): cursor and pack number are each packer's state.

    Samples of a micro-batch are taken in order of seq; micro-batches in order of arrival.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor, number = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        packs = []
        for est in rows["est"].tolist():
            if cursor and cursor + est > most:
                cursor, number = 0, number + 1
            cursor += est
            packs.append(number)
        state.update((cursor, number))
        yield pd.DataFrame({"packer": key[0], "seq": rows["seq"], "est": rows["est"], "pack": packs})

    return samples.groupBy("packer").applyInPandasWithState(step, OUT, "cursor long, number long", "append", GroupStateTimeout.NoTimeout)


def _fields(**kinds) -> StructType:
    return StructType([StructField(k, t()) for k, t in kinds.items()])


class StoredQueue:
    """A queue whose samples stay in a map state, by queue and ordinal; those that come and go within a micro-batch never get there."""

    def __init__(self, name: str, items, ends):
        self.name, self.items, self.ends = name, items, ends
        self.head, self.tail = ends.getValue((name,)) if ends.containsKey((name,)) else (0, 0)
        self.saved = (self.head, self.tail)
        self.fresh: deque = deque()

    def __len__(self) -> int:
        return self.tail - self.head + len(self.fresh)

    def __getitem__(self, i: int) -> tuple:
        return self.items.getValue((self.name, self.head + i)) if self.head + i < self.tail else self.fresh[i - (self.tail - self.head)]

    def __iter__(self) -> Iterator[tuple]:
        return (self[i] for i in range(len(self)))

    def append(self, x: tuple) -> None:
        self.fresh.append(x)

    def popleft(self) -> tuple:
        if self.head == self.tail:
            return self.fresh.popleft()
        out = self[0]
        self.items.removeKey((self.name, self.head))
        self.head += 1
        return out

    def save(self) -> None:
        for x in self.fresh:
            self.items.updateValue((self.name, self.tail), x)
            self.tail += 1
        self.fresh = deque()
        if (self.head, self.tail) != self.saved:
            self.ends.updateValue((self.name,), (self.head, self.tail))
            self.saved = (self.head, self.tail)


class PackerState(StatefulProcessor):
    """One packer's state: where it is (a value), its overflow buffer (a list), and the samples that wait for their turn (a map)."""

    def __init__(self, limits: Limits, mandatory: tuple[str, ...], keys: tuple[str, ...]):
        self.limits, self.mandatory, self.keys = limits, mandatory, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        sample = _fields(seq=LongType, est=LongType, length=LongType)
        self.at = handle.getValueState("at", _fields(pack=LongType, cursor=LongType, place=IntegerType))
        self.buffer = handle.getListState("buffer", sample)
        self.waiting = handle.getMapState("waiting", _fields(queue=StringType, n=LongType), sample)
        self.ends = handle.getMapState("ends", _fields(queue=StringType), _fields(head=LongType, tail=LongType))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        # behind everything else, a sample without an estimate ends the input
        batch = batch.assign(ended=batch["est"].isna()).sort_values(["ended", "seq"], kind="stable")
        pack, cursor, place = self.at.get() if self.at.exists() else (0, 0, 0)
        buffer = deque(tuple(x) for x in self.buffer.get()) if self.buffer.exists() else deque()
        before = list(buffer)
        queues = {g: StoredQueue(f"group {g}", self.waiting, self.ends) for g in self.mandatory}
        packer = Packer(self.limits, self.mandatory, pack, cursor, place, buffer, dict(queues), StoredQueue("free", self.waiting, self.ends))
        out, ended = [], False
        for seq, group, est, length, end in batch[["seq", "group", "est", "length", "ended"]].itertuples(index=False):
            if end:
                ended = True
                break
            out += packer.feed(int(seq), group, int(est), int(length))
        if ended:
            out += packer.end()
            for state in (self.at, self.buffer, self.waiting, self.ends):
                state.clear()
        else:
            self.at.update((packer.pack, packer.cursor, packer.place))
            if not packer.buffer:
                self.buffer.clear()
            elif list(packer.buffer) != before:
                self.buffer.put(list(packer.buffer))
            for q in (*queues.values(), packer.queue):
                q.save()
        made = pd.DataFrame(out, columns=["seq", "pack", "place", "status"]).astype({"pack": "Int64", "place": "Int32"})
        for k, v in zip(self.keys, key, strict=True):
            made[k] = v
        yield made[[*self.keys, "seq", "pack", "place", "status"]]

    def close(self) -> None:
        pass


def stream_full(samples: DataFrame, limits: Limits = Limits(), mandatory: tuple[str, ...] = (), keys: tuple[str, str] = ("rank", "worker")) -> DataFrame:
    """What packing.pack() gives, for a stream of (rank, worker, seq, group, est, length), from micro-batch to micro-batch.

    Samples of a micro-batch are taken in order of seq, micro-batches in order of arrival; a row with a null est ends its packer's input: what is still
    in the buffer or waits for a mandatory sample is reported as left then, and the packer begins anew. A task holds a packer's rows of one micro-batch
    (three numbers and a group each); what waits stays in the state store, which must be RocksDB's.
    """
    conf = samples.sparkSession.conf
    if conf.get(PROVIDER) != ROCKS:
        raise ValueError(f"{PROVIDER} must be {ROCKS}")
    kinds = dict(samples.dtypes)
    ddl = f"{keys[0]} {kinds[keys[0]]}, {keys[1]} {kinds[keys[1]]}, seq long, pack long, place int, status string"
    rows = samples.select(*keys, "seq", "group", samples["est"].cast("long").alias("est"), samples["length"].cast("long").alias("length"))
    return rows.groupBy(*keys).transformWithStateInPandas(PackerState(limits, mandatory, keys), ddl, "append", "none")
