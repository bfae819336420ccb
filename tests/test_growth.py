"""What grows with the tables: pieces of work, what a task is sent, shuffles, repeated columns."""

import math
import pickle
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillpack.queries import QUERIES

from .conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


VECTORS = [(0, [1.0, 2.0]), (1, [2.0, -1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 2.0, 3.0]), (5, [3.0, None]), (100, [-1.0, 0.5]), (200, [0.25, 4.0])]


def vectors(spark):
    df = spark.createDataFrame(VECTORS, "id long, v array<double>")
    return df, df.where("id % 100 = 0")


def cosines():
    out = {}
    for q, x in VECTORS[:1] + VECTORS[6:]:
        for k, y in VECTORS:
            if y is None or None in y or len(x) != len(y):
                out[q, k] = None
            else:
                n = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(a * a for a in y))
                out[q, k] = sum(a * b for a, b in zip(x, y, strict=True)) / n if n else math.nan
    return out


@pytest.mark.parametrize("block", [2, 8192])
def test_pair_cosine(spark, monkeypatch, block):
    from quillpack.operators import reductions as R

    monkeypatch.setattr(R, "BLOCK", block)
    rows = R.cosine_to_queries(*vectors(spark), "id", "v").collect()
    got, want = {(r["q"], r["id"]): r["cosine"] for r in rows}, cosines()
    assert len(rows) == len(want) and got.keys() == want.keys()
    assert all(got[k] is None if x is None else np.isclose(got[k], x, equal_nan=True) for k, x in want.items())


def test_pair_sigmoid_loss(spark, monkeypatch):
    from quillpack.operators import reductions as R

    monkeypatch.setattr(R, "BLOCK", 2)
    some = [x for x in VECTORS if x[0] != 3]
    want = {}
    for (q, k), c in cosines().items():
        if c is not None and k != 3:
            x = 10 * c - 10
            want[q] = want.get(q, 0.0) + math.log(1 + math.exp(-x if q == k else x))
    df = spark.createDataFrame(some, "id long, v array<double>")
    loss = R.sigmoid_loss_to_queries(df, df.where("id % 100 = 0"), "id", "v", 10.0, -10.0).first()["loss"]
    assert loss == pytest.approx(sum(want.values()) / len(want))
    # a query's sums are shuffled, no pair
    assert "cosine" not in plan(QUERIES["pair_sigmoid_loss"](spark, SF))


def test_endless_epochs():
    from quillpack.streaming import epochs

    places = epochs.Places([[f, g, 500] for f in "ab" for g in range(1000)])
    found = list(epochs.pieces(places, 250, 1_200_300))
    assert len(found) < 40 and sum(p.last - p.first for p in found) == 1_200_050
    rows = [(p.epoch, p.file, p.groups[0][0] + k // 500, k % 500) for p in found for k in range(p.first, p.last)]
    assert rows == [(i // 1_000_000, i // 500_000 % 2, i // 500 % 1000, i % 500) for i in range(250, 1_200_300)]
    reader = object.__new__(epochs.EpochReader)
    reader.__dict__.update(places=places, schema=None)
    assert len(pickle.dumps(reader)) < 500


def test_tar_scan():
    from quillpack.sources import shards

    ranges = [[f"s{i % 2}", a, a + 100, a, None] for i in range(2) for a in range(0, 10_000, 100)] + [["s1", None, None, None, "damaged"], ["s2", 0, None, 0, None]]
    found = list(shards.dealt(ranges, 1000))
    assert len(found) == 22 and [[x.shard, x.start, x.end, x.first, x.error] for p in found for x in (p, *p.more)] == ranges
    reader = shards.TarReader({"ranges": "[" + ",".join(["[\"s\", 0, 1, 0, null]"] * 1000) + "]"})
    assert len(pickle.dumps(reader)) < 500


def test_default_tokenizer(spark):
    df = QUERIES["default_tokenizer"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(doc_id" in text


def test_interpolated_positions(spark):
    text = plan(QUERIES["interpolated_positions"](spark, SF))
    assert "Aggregate" in text and "Join" in text


@pytest.mark.parametrize(("name", "draws"), [("compositions", 4), ("frames_rand", 2)])
def test_draws_are_not_repeated(spark, name, draws):
    assert plan(QUERIES[name](spark, SF)).count("md5(") <= draws


def test_line_ordinals(spark):
    from quillpack.sources.readers import text_lines
    from quillpack.sources.scratch import parts

    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert parts(df) == 4 and parts(df, 10_000) > 20
    joined = text_lines(spark, str(Path(__file__).parent / "test_growth.py")).where(F.col("line") >= 0)
    assert "SortMergeJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert "strategy=broadcast" in plan(joined)
