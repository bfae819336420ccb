"""Collated packs and the commit of packs with positions."""

import pytest
from pyspark.sql import functions as F

from quillpack.sources import packs as P

IMAGE = "array<struct<c:int,h:int,w:int,data:array<double>>>"
ROWS = "rank int, worker int, pack long, place int, length long, split_lens array<long>, attn_modes array<string>, dataset string, position array<long>, ids array<int>, at array<long>, images " + IMAGE
KEYS = ["rank", "worker", "pack"]


def picture(c, h, w, first):
    return (c, h, w, [float(first + i) for i in range(c * h * w)])


def samples(spark):
    return spark.createDataFrame([
        (0, 0, 0, 1, 5, [2, 3], ["full", "noise"], "b", [0, 1, 7], [5, 6], [0, 4], [picture(1, 2, 3, 1)]),
        (0, 0, 0, 0, 3, [3], ["causal"], "a", [0, 0, 4], [1], [2], None),
        (0, 0, 0, 2, 1, [1], ["full"], "a", [0, 0, 5], [], [], [picture(2, 3, 1, 50)]),
        (0, 0, 1, 0, 12, [12], ["full"], "a", [0, 0, 2], [9], [0], []),
        (1, 0, 0, 0, 10, [10], ["full"], "c", [3, 3, 3], None, [1], []),
    ], ROWS)


def test_collated(spark):
    a, b, c = P.collated(samples(spark), KEYS, "place", 10, ["ids"], ["at"], "images").orderBy(*KEYS).collect()
    assert (a["sequence_length"], a["sample_lens"], a["split_lens"], a["attn_modes"]) == (9, [3, 5, 1, 1], [3, 2, 3, 1, 1], ["causal", "full", "noise", "full", "full"])
    assert a["ids"] == [1, 5, 6] and a["at"] == [2, 3, 7] and a["positions"] == {"a": [0, 0, 5], "b": [0, 1, 7]}
    assert tuple(a["image_shape"]) == (2, 3, 3)
    first, second = a["padded_images"][:18], a["padded_images"][18:]
    assert first == [1, 2, 3, 4, 5, 6, 0, 0, 0] + [0] * 9 and second == [50, 0, 0, 51, 0, 0, 52, 0, 0, 53, 0, 0, 54, 0, 0, 55, 0, 0]
    # too long for a pad; exactly full: a pad of nothing
    assert (b["sample_lens"], b["attn_modes"], b["padded_images"]) == ([12], ["full"], [])
    assert (c["sample_lens"], c["split_lens"], c["ids"]) == ([10, 0], [10, 0], [])


def test_steps_are_whole(spark, tmp_path):
    path, made = str(tmp_path / "out"), P.collated(samples(spark), KEYS, "place", 10, ["ids"], ["at"], "images")
    assert P.read_collated(spark, path) is None
    P.write_collated(made.repartition(3), path, 9, KEYS)
    got, positions = P.read_collated(spark, path)
    assert sorted(map(str, got.select(*made.columns).collect())) == sorted(map(str, made.collect()))
    # the pack with the greater number tells where its reader is
    assert sorted(map(tuple, positions.collect())) == [(["0", "0"], "a", [0, 0, 2]), (["0", "0"], "b", [0, 1, 7]), (["1", "0"], "c", [3, 3, 3])]
    bad = made.withColumn("sequence_length", F.when(F.col("rank") == 1, F.raise_error(F.lit("bad pack")).cast("long")).otherwise(F.col("sequence_length")))
    with pytest.raises(Exception, match="bad pack"):
        P.write_collated(bad.repartition(3), path, 10, KEYS)
    assert P.steps(spark, path) == [9] and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0000009"]
    with pytest.raises(Exception, match="step 9 is written"):
        P.write_collated(made, path, 9, KEYS)
    assert P.read_collated(spark, path)[0].count() == 3 and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0000009"]
    # a commit that was cut off, and the step written again
    (tmp_path / "out" / "0000011").mkdir()
    assert P.steps(spark, path) == [9] and P.read_collated(spark, path, 11) is None
    P.write_collated(made.where("rank = 1"), path, 11, KEYS)
    assert P.read_collated(spark, path)[0].count() == 1
    P.write_collated(made.where("rank = 5"), path, 12, KEYS)
    assert P.read_collated(spark, path, 12) is None and P.steps(spark, path) == [9, 11, 12]
