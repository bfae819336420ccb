"""The packer on a stream: any cut into micro-batches, restarts in between, gives what the batch packer does."""

import random

import pytest
from pyspark.sql import functions as F

from quillpack.operators.packing import Limits, pack
from quillpack.streaming.packer import PROVIDER, ROCKS, StoredQueue, stream_full

SAMPLES = "rank int, worker int, seq long, group string, est long, length long"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    yield
    spark.conf.set(PROVIDER, old)


class Map:
    """A map state in memory."""

    def __init__(self):
        self.rows = {}
        self.containsKey, self.getValue, self.removeKey, self.updateValue = self.rows.__contains__, self.rows.get, self.rows.pop, self.rows.__setitem__


def test_stored_queue():
    rnd, items, ends, want = random.Random(1), Map(), Map(), []
    q = StoredQueue("a", items, ends)
    for i in range(2000):
        if rnd.random() < 0.52 or not want:
            want.append((i, i, i))
            q.append((i, i, i))
        else:
            assert q.popleft() == want.pop(0)
        assert len(q) == len(want) and list(q)[:3] == want[:3]
        if i % 37 == 0:
            q.save()
            q = StoredQueue("a", items, ends)
    q.save()
    assert len(items.rows) == len(want)


def test_provider_is_asked_for(spark, tmp_path):
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            stream_full(spark.readStream.schema(SAMPLES).parquet(str(tmp_path)))
    finally:
        spark.conf.set(PROVIDER, old)


@pytest.mark.parametrize("mandatory", [(), ("must", "also")])
def test_restarts_and_cuts_change_nothing(spark, rocks, tmp_path, mandatory):
    rnd = random.Random(len(mandatory))
    rows = []
    for rank in range(2):
        for worker in range(2):
            for i in range(150):
                est = rnd.choice([1, 3, 5, 9, 11, 12, 13, 19])
                rows.append((rank, worker, i, rnd.choice(["must", "also", "free", "free", "free"]), est, est + (i % 9 == 0)))
    limits = Limits(20, 24, 12, 8, 2)
    samples = spark.createDataFrame(rows, SAMPLES)
    want = sorted(map(str, pack(samples, limits, mandatory).collect()))
    source, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    cuts = [0, 1, 40, 41, 100, 150]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = samples.where(F.col("seq").between(a, b - 1))
        if b == 150:
            part = part.unionByName(samples.select("rank", "worker").distinct().withColumn("seq", F.lit(0).cast("long")), allowMissingColumns=True)
        part.coalesce(1).write.mode("append").parquet(source)
        # one run over each part; every run starts anew from the checkpoint
        q = stream_full(spark.readStream.schema(SAMPLES).parquet(source), limits, mandatory).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.schema(pack(samples, limits, mandatory).schema).parquet(out)
    assert sorted(map(str, got.collect())) == want
    statuses = {r["status"] for r in got.select("status").distinct().collect()}
    assert statuses >= {"packed", "too long", "dropped at flush"}


def test_places():
    from quillpack.streaming.epochs import Places

    p = Places([["a", 0, 3], ["a", 1, 0], ["a", 2, 2], ["b", 0, 4]])
    assert [p.ordinal(p.place(i)) for i in range(40)] == list(range(40)) and p.place(12) == {"epoch": 1, "file": 0, "row_group": 2, "row": 0}
    for a in range(0, 30, 7):
        for b in range(a, 45, 5):
            got = [(e, f, g, r) for e, f, _, g, x, y in p.between(a, b) for r in range(x, y)]
            assert got == [tuple(p.place(i).values()) for i in range(a, b)]
    assert list(Places([["a", 0, 0]]).between(0, 0)) == [] and Places([]).place(0)["epoch"] == 0


def test_endless_goes_on_after_a_failure(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quillpack.streaming.epochs import endless

    (tmp_path / "in").mkdir()
    for name, n in (("a", 25), ("b", 7)):
        pq.write_table(pa.table({"x": [f"{name}{i}" for i in range(n)], "t": pa.array([None if i % 3 else i for i in range(n)], pa.int32())}), tmp_path / "in" / f"{name}.parquet", row_group_size=10)
    out, at, notes = str(tmp_path / "out"), str(tmp_path / "at"), str(tmp_path / "notes" / "end")

    def go(fail=False, **how):
        s = endless(spark, str(tmp_path / "in"), rows=15, notes=notes, **how)
        s = s.withColumn("x", F.raise_error(F.lit("stopped")).cast("string")) if fail else s
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()

    for fail in (False, True, False, False, True, True, False):
        if fail:
            with pytest.raises(Exception, match="stopped"):
                go(True)
        else:
            go()
    rows = spark.read.parquet(out).orderBy("epoch", "file", "row_group", "row").collect()
    names = [f"a{i}" for i in range(25)] + [f"b{i}" for i in range(7)]
    assert len(rows) >= 60 and [r["x"] for r in rows] == [names[i % 32] for i in range(len(rows))]
    assert [(r["epoch"], r["row_group"], r["row"]) for r in rows[:32]] == [(0, i // 10, i % 10) for i in range(25)] + [(0, 0, i) for i in range(7)]
    # from a saved place
    out, at, notes = str(tmp_path / "out2"), str(tmp_path / "at2"), str(tmp_path / "notes2" / "end")
    go(start={"epoch": 3, "file": 0, "row_group": 2, "row": 4})
    assert [r["x"] for r in spark.read.parquet(out).orderBy("epoch", "file", "row_group", "row").collect()] == ["a24", *names[25:], *names[:7]]
