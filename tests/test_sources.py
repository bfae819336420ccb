"""Dataset groups and readers over small files of every kind."""

import io
import json
import tarfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillpack.functions import arrays, tokenizers
from quillpack.operators import gathers as G
from quillpack.sources import datasets as D


def tar(path, samples):
    with tarfile.open(path, "w") as t:
        for name, data in samples:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return str(path)


def shape(df):
    return [[(e["type"], e["has_loss"], e["text"], e["round"]) for e in r["elements"]] for r in df.collect()]


def test_groups():
    gs = D.groups({"a": {"dataset_names": ["x", "y"], "num_used_data": [3, "None"], "weight": 1}, "b": {"dataset_names": ["z"], "is_mandatory": True, "is_auxiliary": True}})
    assert [(g.name, g.used, g.weight, g.mandatory, g.resume) for g in gs] == [("a", [3, None], 1.0, False, True), ("b", [None], 0.0, True, True)]
    with pytest.raises(ValueError):
        D.groups({"a": {"dataset_names": ["x"]}})
    with pytest.raises(KeyError):
        D.root({"a": {}}, "a", "x")
    assert D.merged_info([{"a": 1, "b": 1}, {"b": 2}]) == {"a": 1, "b": 2}


def test_captioned(spark, tmp_path):
    image = pa.array([{"bytes": b"p"}] * 3, pa.struct([("bytes", pa.binary())]))
    pq.write_table(pa.table({"image": image, "caption": [" a ", " ", None]}), tmp_path / "a.parquet")
    got = shape(D.READERS["t2i_parquet"](spark, [str(tmp_path / "a.parquet")]))
    assert got == [[("text", 0, "a", 0), ("image", 1, None, 0)]]
    pq.write_table(pa.table({"image": image, "caption_text": ["x", None, " "], "caption_style": ["x", "y ", None]}), tmp_path / "b.parquet")
    got = shape(D.READERS["t2i_parquet"](spark, [str(tmp_path / "b.parquet")]))
    assert [s[0][2] for s in got] == ["x", "y", " "]
    shard = tar(tmp_path / "c.tar", [("1.png", b"p"), ("1.txt", b"one"), ("2.txt", b"no image"), ("3.jpg", b"p"), ("3.json", json.dumps({"conversations": [{"value": "q"}, {"value": "a"}]}).encode())])
    assert [s[0][2] for s in shape(D.READERS["t2i_wds"](spark, [shard]))] == ["one", "a"]


def test_conversations(spark, tmp_path):
    turn = pa.struct([("from", pa.string()), ("value", pa.string())])
    rows = pa.table({"conversations": pa.array([[{"from": "human", "value": "<image>q"}, {"from": "gpt", "value": "a"}], [{"from": "human", "value": "q"}], [{"from": "human", "value": "<image>"}, {"from": "gpt", "value": "z"}]], pa.list_(turn)), "image": pa.array([{"bytes": b"p"}, {"bytes": b"p"}, None], pa.struct([("bytes", pa.binary())]))})
    pq.write_table(rows, tmp_path / "a.parquet")
    path = [str(tmp_path / "a.parquet")]
    assert shape(D.READERS["vlm_parquet"](spark, path)) == [[("image", 0, None, 1), ("text", 0, "q", 1), ("text", 1, "a", 1)]]
    assert len(shape(D.READERS["sft_parquet"](spark, path))) == 2
    pq.write_table(pa.table({"other": [1]}), tmp_path / "b.parquet")
    assert D.READERS["sft_parquet"](spark, [str(tmp_path / "b.parquet")]).count() == 0
    talk = lambda *t: json.dumps({"conversations": [{"from": ("human", "gpt")[i % 2], "value": x} for i, x in enumerate(t)]}).encode()
    shard = tar(tmp_path / "c.tar", [("1.jpg", b"p"), ("1.json", talk("see <image> this", "")), ("2.jpg", b""), ("2.json", talk("no image", "ok")), ("3.json", b"{broken")])
    assert shape(D.READERS["vlm_wds"](spark, [shard])) == [[("image", 0, None, 1), ("text", 0, "see  this", 1), ("text", 1, "", 1)]]
    assert shape(D.READERS["llm_wds"](spark, [shard])) == [[("text", 0, "see", 1), ("image", 0, None, 1), ("text", 0, "this", 1), ("text", 1, "", 1)], [("text", 0, "no image", 1), ("text", 1, "ok", 1)]]
    lines = [{"image": "a.jpg", "conversations": [{"from": "human", "value": "<image>q"}, {"from": "gpt", "value": "a"}]}, {"video": "v/", "conversations": [{"from": "human", "value": "<video>w"}, {"from": "gpt", "value": "b"}]}]
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    got = D.conversation_lines(spark, str(tmp_path / "l.jsonl"), "x", frames=F.lit(2)).orderBy("line")
    assert shape(got) == [[("image", 0, None, 0), ("text", 0, "q", 0), ("text", 1, "a", 0)], [("image", 0, None, 0), ("image", 0, None, 0), ("text", 0, "w", 0), ("text", 1, "b", 0)]]
    est = D.estimated(got, image_tokens=10).collect()
    assert [(r["num_tokens"], r["est"]) for r in est] == [(12, 18), (22, 30)]


def test_edits(spark, tmp_path):
    pq.write_table(pa.table({"image_list": pa.array([[b"a", b"b", b"c"]], pa.list_(pa.binary())), "instruction_list": pa.array([[["x"], ["y"]]], pa.list_(pa.list_(pa.string())))}), tmp_path / "a.parquet")
    seen = set()
    for seed in range(12):
        s = shape(D.READERS["unified_edit"](spark, [str(tmp_path / "a.parquet")], seed))[0]
        assert s[0][:2] == ("image", 0) and s[-1][:2] == ("image", 1) and sum(e[0] == "text" for e in s) >= 1
        seen.add(tuple(e[2] for e in s if e[0] == "text"))
    assert len(seen) > 1
    mark = "<img><|image_{}|></img>"
    shard = tar(tmp_path / "b.tar", [("1.image_1.jpg", b"p"), ("1.image_3.jpg", b"p"), ("1.output.jpg", b"o"), ("1.txt", f"use {mark.format(1)} and {mark.format(2)} or {mark.format(3)}".encode()), ("2.image_1.jpg", b"p"), ("2.output.jpg", b"o"), ("2.txt", b"make <image> it "), ("3.src_img", b"s"), ("3.edited_img", b"e"), ("3.edited_prompt", b"redo"), ("4.weird", b"")])
    got = [[(k, x, t) for k, x, t, _ in s] for s in shape(D.READERS["unified_wds_edit"](spark, [shard]))]
    assert got == [
        [("text", 0, "use "), ("image", 1, "image_1"), ("text", 0, " and "), ("text", 0, " or "), ("image", 1, "image_3"), ("image", 1, "output")],
        [("image", 0, "image_1"), ("text", 0, "make  it"), ("image", 1, "output")],
        [("image", 0, "input"), ("text", 0, "redo"), ("image", 1, "output")],
    ]


def test_tokenizer_plumbing(spark):
    assert tokenizers.special_ids({"<|endoftext|>": 3, "x": 7}) == ({"<|startoftext|>": 8, "<|endoftext|>": 3, "<|vision_start|>": 9, "<|vision_end|>": 10}, 3)
    assert tokenizers.joined(["▁a", "b", "</s>", "</s>", "▁c"], {"</s>"}) == "ab </s></s> c"
    one = spark.range(1).select(tokenizers.special_mask(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))).alias("m")).first()["m"]
    assert one == [0, 0, 1, 0, 1]

    class Lengths:
        def encode(self, texts):
            return [[len(t)] for t in texts]

    rows = spark.createDataFrame([("abc",), (None,)], "t string").select(tokenizers.encoder(Lengths)(F.col("t")).alias("ids")).collect()
    assert sorted(r["ids"] for r in rows) == [[0], [3]]


def test_arrays(spark):
    v = spark.range(1).select(F.array(*map(F.lit, range(48))).alias("v"))
    assert v.select(arrays.unpatchify(arrays.patchify(F.col("v"), 3, 4, 4, 2), 3, 4, 4, 2).alias("x")).first()["x"] == list(range(48))
    ids = spark.createDataFrame([(2, 2), (4, 4), (0, 3), (5, 1)], "h int, w int").select(arrays.interpolated_ids(F.col("h"), F.col("w"), 4).alias("x")).collect()
    assert [r["x"] for r in ids] == [[0, 2, 8, 10], list(range(16)), [], [0, 0, 4, 8, 12]]
    for decay in (1.0, 0.9):
        rows = spark.range(300).select((F.col("id") % 30 + 1).alias("n"), arrays.composition(F.col("id") % 30 + 1, decay, 3, "id").alias("c")).collect()
        for r in rows:
            parts, ends = r["c"]
            assert sum(parts) == r["n"] and min(parts) > 0 and ends[0] == 0 and ends[-1] == r["n"] and [b - a for a, b in zip(ends, ends[1:], strict=False)] == parts
        assert len({len(r["c"][0]) for r in rows}) > 5


def test_plan_items(spark):
    from quillpack.operators import elements as E

    df = spark.createDataFrame([([(3, 32, 32), (7, 32, 48)], 1), ([(5, 16, 16)], 0), ([], 0)], "frames array<struct<index:int,h:int,w:int>>, loss int")
    a, b, c = df.select(E.video_items(F.col("frames"), F.col("loss")).alias("i"), E.frame_tokens(F.col("frames"), 16).alias("n")).collect()
    assert [tuple(x) for x in a["i"]] == [("vae_image", 0, 1, 0, None, True, False, 4), ("vae_image", 0, 1, 0, None, False, True, None)] and a["n"] == 10
    assert [tuple(x) for x in b["i"]] == [("vae_image", 1, 0, 0, None, True, True, None)] and (c["i"], c["n"]) == ([], 0)


def test_used_lines(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(5)))
    sources = spark.createDataFrame([(0, str(tmp_path / "a"), "x", 2), (1, str(tmp_path / "b"), "y", None)], "line long, path string, folder string, quota int")
    got = [tuple(r) for r in D.used_lines(spark, sources).orderBy("source", "line").collect()]
    assert got == [(0, "x", 0, "a0"), (0, "x", 1, "a1")] + [(1, "y", i, f"b{i}") for i in range(5)]
    drawn = {r["value"] for r in D.used_lines(spark, sources.where("quota = 2"), seed=3).collect()}
    assert len(drawn) == 2 and D.used_lines(spark, sources.limit(0)).count() == 0


def test_gathers(spark):
    have, want = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string")
    assert [[r[0] for r in x.collect()] for x in G.key_difference(have, want, "k")] == [["b"], ["a"], ["c"]]
    got = spark.createDataFrame([(3, 8, 5), (-2, 4, 5), (7, 9, 5)], "s int, e int, n int").select(*G.span_labels(F.col("s"), F.col("e"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(3, None), (0, 4), (None, None)]
    beams = spark.createDataFrame([(0, "x"), (1, "y")], "beam int, v string")
    assert sorted((r["place"], r["v"]) for r in G.reordered(beams, spark.createDataFrame([(0, 1), (1, 1)], "place int, beam int"), "beam", "place").collect()) == [(0, "y"), (1, "y")]
    assert sorted((r["branch"], r["p"]) for r in G.doubled(spark.createDataFrame([(0,), (1,)], "p int"), "p", 2).collect()) == [(0, 0), (0, 1), (1, 2), (1, 3)]


def test_offsets_go_on_where_they_were_saved(spark, tmp_path):
    from quillpack.operators.shards import after, epochs
    from quillpack.sources.sinks import read_offsets, write_offsets

    path = str(tmp_path / "offsets")
    assert read_offsets(spark, path) is None
    for step, row in ((9, 3), (10, 5)):
        where = write_offsets(spark.createDataFrame([("a", 0, row)], "dataset string, worker int, row long"), path, step)
        assert where.endswith(f"{step:07d}")
    saved, step = read_offsets(spark, path)
    assert [tuple(r) for r in saved.collect()] == [("a", 0, 5)] and step == 11
    rows = spark.createDataFrame([(f, r) for f in range(2) for r in range(8)], "file long, row long")
    assert sorted(map(tuple, after(rows, (0, 5), "file", "row").collect())) == [(0, 6), (0, 7)] + [(1, r) for r in range(8)]
    assert sorted(r["epoch"] for r in epochs(rows.limit(1), 3).collect()) == [0, 1, 2]
