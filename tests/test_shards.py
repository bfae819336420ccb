"""Tar shards in ranges, row groups by their footers, line ordinals under any split."""

import io
import tarfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillpack.sources import readers, shards


def tar(path, files, mode="w", **how):
    with tarfile.open(path, mode, **how) as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return str(path)


def whole(path):
    """Samples by reading the shard from its beginning."""
    out = []
    with tarfile.open(path) as t:
        for m in t:
            if m.isfile():
                k, ext = shards.split_name(m.name)
                if not out or out[-1][0] != k:
                    out.append((k, {}))
                out[-1][1][ext] = t.extractfile(m).read()
    return [(i, *x) for i, x in enumerate(out)]


def files(n):
    long = "a very long folder name " * 8
    out = []
    for i in range(n):
        out += [(f"{long if i % 7 == 3 else 'd'}/{i:05d}.txt", b"t" * (i * 37 % 900)), (f"{long if i % 7 == 3 else 'd'}/{i:05d}.a.json", b"{}" * (i % 5))]
    return out


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
@pytest.mark.parametrize("split", [1, 700, 10_000, 1 << 30])
def test_ranges_give_the_shard(tmp_path, form, split):
    names = files(60) if form != tarfile.USTAR_FORMAT else [f for f in files(60) if len(f[0]) < 90]
    path = tar(tmp_path / "s.tar", names, format=form)
    ranges = list(shards.cut(path, split))
    got = [(i, k, m) for r in ranges for i, k, m, e in shards.samples(path, r["start"], r["end"], r["first"])]
    assert got == whole(path)
    assert all(r["error"] is None for r in ranges) and (len(ranges) > 20) == (split <= 700)


def test_read_by_spark(spark, tmp_path):
    tar(tmp_path / "a.tar", files(50))
    tar(tmp_path / "b.tar", [])
    tar(tmp_path / "c.tar.gz", files(9), "w:gz")
    df = shards.tar_samples(spark, str(tmp_path), split=2000, batch=3000)
    assert df.rdd.getNumPartitions() > 5
    got = sorted((r["shard"].rsplit("/", 1)[1], r["sample_idx"], r["key"], {k: bytes(v) for k, v in r["members"].items()}, r["error"]) for r in df.collect())
    assert got == [(n, *x, None) for n in ("a.tar", "c.tar.gz") for x in whole(tmp_path / n)]
    (tmp_path / "none").mkdir()
    assert shards.tar_samples(spark, str(tmp_path / "none")).count() == 0


def test_damage_and_oversize_are_rows(spark, tmp_path):
    path = tar(tmp_path / "a.tar", [(f"{i}.x", bytes([i]) * 600) for i in range(20)])
    data = bytearray((tmp_path / "a.tar").read_bytes())
    at = (512 + 1024) * 15
    data[at : at + 512] = b"\xff" * 512
    (tmp_path / "a.tar").write_bytes(data)
    for split in (1, 3000, 1 << 30):
        rows = shards.tar_samples(spark, path, split=split).orderBy(F.asc_nulls_last("sample_idx")).collect()
        assert [r["key"] for r in rows] == [str(i) for i in range(15)] + [None] and rows[-1]["error"] and not any(r["error"] for r in rows[:-1])
    # cut within a member
    (tmp_path / "b.tar").write_bytes(bytes(data[: (512 + 1024) * 3 + 700]))
    rows = shards.tar_samples(spark, str(tmp_path / "b.tar")).orderBy(F.asc_nulls_last("sample_idx")).collect()
    assert [r["key"] for r in rows] == ["0", "1", "2", None]
    (tmp_path / "c.tar").write_bytes(b"no tar " * 200)
    assert [(r["key"], r["error"] is None) for r in shards.tar_samples(spark, str(tmp_path / "c.tar")).collect()] == [(None, False)]
    big = tar(tmp_path / "d.tar", [("1.x", b"1"), ("2.x", b"2" * 5000), ("2.y", b"2"), ("3.x", b"3")])
    rows = shards.tar_samples(spark, big, largest=1000).orderBy("sample_idx").collect()
    assert [(r["key"], r["members"] is None, r["error"]) for r in rows] == [("1", False, None), ("2", True, "2.x: 5000 bytes"), ("3", False, None)]


def test_batches_are_bounded(tmp_path):
    path = tar(tmp_path / "a.tar", [(f"{i}.x", b"x" * 1000) for i in range(300)])
    reader = shards.TarReader({"ranges": "[]", "batch": "10000"})
    batches = list(reader.read(shards.Range(path, 0, None, 0, None)))
    assert sum(len(b) for b in batches) == 300 and max(b.nbytes for b in batches) < 12_000


def test_failed_writers_leave_nothing(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("s"), F.col("id") % 4, F.lit(".tar")).alias("shard"), F.col("id").cast("string").alias("name"), F.encode(F.lit("x"), "utf-8").alias("content"), "id")
    shards.write_tar(rows, str(tmp_path / "ok"), "id")
    assert sorted(p.name for p in (tmp_path / "ok").iterdir()) == [f"s{i}.tar" for i in range(4)]
    assert [x[1] for x in whole(tmp_path / "ok" / "s1.tar")] == [str(i) for i in range(1, 100, 4)]
    bad = rows.withColumn("content", F.when(F.col("id") == 77, F.raise_error(F.lit("bad row"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="bad row"):
        shards.write_tar(bad, str(tmp_path / "bad"), "id")
    assert [p for p in (tmp_path / "bad").rglob("*") if p.is_file()] == []


@pytest.mark.parametrize("split", ["200b", "1k", "128m"])
def test_lines_are_numbered_in_file_order(spark, tmp_path, split):
    want = []
    for name, n in (("a", 40), ("b", 0), ("c", 300), ("d", 1)):
        lines = [f"{name}{i} " + "é" * (i * 7 % 50) if i % 9 else "" for i in range(n)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + ("\n" if n > 1 else ""))
        want += lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = readers.text_lines(spark, str(tmp_path)).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in got] == list(enumerate(x.rstrip("\n") for x in want if x is not None))[: len(got)] and len(got) in (len(want), len(want) - 1)


def test_row_groups_read_no_columns(spark, tmp_path):
    folder = tmp_path / "odd name+1%"
    folder.mkdir()
    pq.write_table(pa.table({"x": list(range(10_000))}), folder / "a.parquet", row_group_size=3000)
    pq.write_table(pa.table({"x": []}, schema=pa.schema([("x", pa.int64())])), folder / "b.parquet")
    got = readers.positioned(spark, str(folder)).orderBy("x").collect()
    assert [(r["row_group"], r["row"]) for r in got] == [(i // 3000, i % 3000) for i in range(10_000)]
    # a file whose column chunks are overwritten still has its groups
    data = bytearray((folder / "a.parquet").read_bytes())
    data[4:2000] = b"\0" * 1996
    (tmp_path / "c.parquet").write_bytes(data)
    assert [tuple(r)[1:] for r in readers.row_groups(spark, str(tmp_path / "c.parquet")).orderBy("row_group").collect()] == [(0, 0, 3000), (1, 3000, 3000), (2, 6000, 3000), (3, 9000, 1000)]
