"""Fixed values and literal simulations of the operators that SQL doesn't check."""

import io
import math
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from quillpack.functions import arrays, mathx, media
from quillpack.functions.text import canonical, clean_response, with_end
from quillpack.operators import elements as E
from quillpack.operators import layout as L
from quillpack.operators.packing import Limits, pack


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("w", "h", "gen", "und", "four"),
    [(640, 480, (688, 512), (644, 476), (644, 476)), (1024, 1024, (1024, 1024), (980, 980), (518, 518)), (2000, 1000, (1024, 512), (980, 490), (980, 490)), (4000, 500, (1024, 128), (980, 126), (980, 126)), (100, 100, (512, 512), (378, 378), (378, 378)), (513, 37, (1024, 80), (980, 70), (980, 70))],
)
def test_resized(spark, w, h, gen, und, four):
    size = lambda *a: one(spark, *media.resized(F.lit(w), F.lit(h), *a))
    assert tuple(size(1024, 512, 16, 1806336)) == gen
    assert tuple(size(980, 378, 14, 2007040)) == und
    assert tuple(size(980, 378, 14, 2007040, 4)) == four


def test_frames(spark):
    assert one(spark, media.frames_middle(F.lit(100), 8))[0] == [5, 18, 30, 43, 55, 68, 80, 93]
    assert one(spark, media.frames_middle(F.lit(5), 8))[0] == [0, 1, 2, 3, 4, 4, 4, 4]
    assert one(spark, media.frames_rate(F.lit(100), F.lit(25.0), 1.0))[0] == [12, 38, 62, 88]
    assert one(spark, media.frames_rate(F.lit(100), F.lit(25.0), 0.5))[0] == [25, 75]
    assert one(spark, media.frames_rate(F.lit(7), F.lit(3.0), 2.0))[0] == [1, 2, 4, 5]


def test_lengths(spark):
    padded = [one(spark, arrays.padded_length(F.lit(n).cast("long")))[0] for n in (5, 8, 12, 13, 16, 24, 25, 100)]
    assert padded == [6, 12, 12, 16, 24, 24, 32, 128]
    counts = lambda n: one(spark, arrays.split_counts(F.lit(n).cast("long")))[0]
    assert [counts(n) for n in (16, 17, 32, 96, 513)] == [[1], [1], [1, 2], [1, 2, 4], [2, 4, 8, 16, 32]]
    assert counts(1024) == [2, 4, 8, 16, 32, 64]
    assert counts(5000) == [16, 32, 64, 128, 256]
    assert one(spark, arrays.transfer_counts(F.lit(31), 8))[0] == [4] * 7 + [3]
    assert one(spark, arrays.transfer_counts(F.lit(5), 8))[0] == [1] * 5 + [0] * 3
    assert [one(spark, arrays.power_above(F.lit(n).cast("long")))[0] for n in (-1, 0, 1, 2, 3, 8)] == [1, 1, 2, 4, 4, 16]
    assert mathx.grid(5, 3.0) == pytest.approx([1, 0.9, 0.75, 0.5, 0])


def test_text(spark):
    assert one(spark, clean_response(F.lit("a</think>b</think> c<|endoftext|> \n")))[0] == "c"
    assert one(spark, canonical(F.lit(" a, b!  {x}. \n c"), "{x}"))[0] == "a b {x} c"
    assert one(spark, with_end(F.array(F.lit(1), F.lit(2)), 2))[0] == [1, 2]
    assert one(spark, with_end(F.array(F.lit(1)), 2))[0] == [1, 2]


def test_conversation_styles(spark):
    rows = spark.createDataFrame(
        [
            (1, [("<image> hi ", "yes", None, None, None, None), ("<image>", "", None, None, None, None)]),
            (2, [(None, None, "human", "q", None, None), (None, None, "gpt", "a", None, None), (None, None, "human", "r", None, None)]),
            (3, [(None, None, None, None, "system", "s"), (None, None, None, None, "user", "q"), (None, None, None, None, "assistant", "a")]),
            (4, []),
        ],
        "id long, turns array<struct<user:string,assistant:string,from:string,value:string,role:string,content:string>>",
    )
    got = {r[0]: [(e["text"], e["has_loss"], e["round"]) for e in r[1]] for r in rows.select("id", E.conversation_elements(F.col("turns"), ["user", "assistant", "from", "value", "role", "content"])).collect()}
    assert got == {1: [("hi", 0, 2), ("yes", 1, 2)], 2: [("q", 0, 1), ("a", 1, 1), ("r", 0, 1)], 3: [("q", 0, 1), ("a", 1, 1)], 4: []}


def test_inline_images(spark):
    get = lambda t, n: [(e["type"], e["text"]) for e in one(spark, E.inline_elements(F.lit(t), n))[0]]
    assert get(" no tag ", 3) == [("text", " no tag ")]
    assert get("<image> a <image>b", 1) == [("image", None), ("text", "a"), ("text", "b")]
    assert get("a<image><image>", 5) == [("text", "a"), ("image", None), ("image", None)]


def test_pairs_agree_with_tokens(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(12):
        at = 0
        for s in range(rnd.randrange(1, 6)):
            n = rnd.randrange(1, 5)
            rows.append((k, s, n, rnd.choice(["full", "noise", "causal"]), at, 0))
            at += n
    segs = spark.createDataFrame(rows + [(99, 0, 3, "full", 0, 0), (99, 1, 2, "noise", 3, 0), (99, 2, 2, "full", 5, 0)], "k int, split_ord int, len long, mode string, start long, rope long")
    t = L.tokens(segs, ["k"])
    q, v = t.alias("q"), t.alias("v")
    c = lambda a, n: F.col(f"{a}.{n}")
    met = q.join(v, c("q", "k") == c("v", "k")).where(L.may_attend(c("q", "pos"), c("v", "pos"), c("q", "split_ord"), c("v", "split_ord"), c("q", "mode"), c("v", "mode")))
    by_token = {(r[0], r[1]): r[2] for r in met.groupBy("q.k", "q.split_ord").count().collect()}
    by_segment = {(r[0], r[1]): r[2] for r in L.pair_counts(segs, ["k"]).collect()}
    assert by_token == by_segment
    assert [by_segment[99, s] for s in range(3)] == [9, 10, 10]


SPLITS = [("a", [(3, "full"), (2, "noise"), (4, "causal"), (1, "noise"), (2, "full")]), ("b", [(1, "causal")]), ("c", [(2, "noise"), (3, "noise"), (2, "causal")])]


def split_rows(spark):
    rows = [(key, i, n, mode, sum(x for x, _ in splits[:i])) for key, splits in SPLITS for i, (n, mode) in enumerate(splits)]
    return spark.createDataFrame(rows, "k string, split_ord int, len long, mode string, start long")


def seen_by_pairs():
    out = {}
    for key, splits in SPLITS:
        t = [(i, mode) for i, (n, mode) in enumerate(splits) for _ in range(n)]
        for a, (i, mode) in enumerate(t):
            out[key, a] = [b for b, (j, other) in enumerate(t) if (a >= b or (i == j and mode in ("full", "noise"))) and not (other == "noise" and i != j)]
    return out


def test_mask_rows(spark):
    from quillpack.plans import details

    rows = L.mask_rows(split_rows(spark), ["k"], lambda x: x).collect()
    assert {(r["k"], r["pos"]): r["seen"] for r in rows} == seen_by_pairs() and len(rows) == len(seen_by_pairs())
    # no pair of tokens is made
    assert "Join" not in details.attn_mask_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_seen(spark):
    from quillpack.plans import details

    rows = L.tokens_seen(split_rows(spark), ["k"]).collect()
    assert {(r["k"], r["pos"]): r["seen"] for r in rows} == {k: len(x) for k, x in seen_by_pairs().items()}
    assert "Join" not in details.attn_pairs_token(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def literal(samples, m, mandatory):
    """The packer by its description, over one ordered list."""
    free = [s for s in samples if s[1] not in mandatory]
    must = {g: [s for s in samples if s[1] == g] for g in mandatory}
    out, buf, cur, number, place, opened = {}, [], 0, 0, 0, False
    while True:
        if cur == 0 and place == 0 and mandatory:
            for g in mandatory:
                while must[g] and must[g][0][2] >= m.sample:
                    out[must[g].pop(0)[0]] = "too long"
                if not must[g]:
                    opened = True
                    break
            if opened:
                break
            for g in mandatory:
                s = must[g].pop(0)
                out[s[0]] = (number, place)
                cur, place = cur + s[3], place + 1
        if cur < m.prefer and buf:
            s, old = buf.pop(0), True
        elif free:
            s, old = free.pop(0), False
        else:
            break
        if s[2] > m.sample:
            out[s[0]] = "too long"
        elif cur + s[2] > m.most:
            if not old and len(buf) < m.capacity:
                buf.append(s)
            else:
                out[s[0]] = "dropped at flush"
                number, cur, place = number + 1, 0, 0
        else:
            out[s[0]] = (number, place)
            cur, place = cur + s[3], place + 1
            if cur >= m.target:
                number, cur, place = number + 1, 0, 0
    return out | {s[0]: "left" for s in [*buf, *free, *(x for q in must.values() for x in q)]}


@pytest.mark.parametrize("mandatory", [(), ("a", "b")])
def test_packer(spark, mandatory):
    m = Limits(20, 24, 12, 8, 2)
    rnd = random.Random(3)
    samples = []
    for i in range(300):
        # mandatory samples come early enough that the simulation never waits for one
        g = ("a", "b")[i % 2] if mandatory and i < 160 else "c"
        est = rnd.randrange(1, 14)
        samples.append((i, g, est, est + rnd.randrange(3)))
    rows = spark.createDataFrame([(0, 1, *s) for s in samples], "rank int, worker int, seq long, group string, est long, length long")
    got = {r["seq"]: (r["pack"], r["place"]) if r["status"] == "packed" else r["status"] for r in pack(rows, m, mandatory).collect()}
    assert got == literal(samples, m, mandatory)
    assert pack(rows.limit(0), m, mandatory).count() == 0


def test_tar(spark, tmp_path):
    from quillpack.sources.shards import tar_samples

    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for name, data in (("x/1.jpg", b"p"), ("x/1.json", b'{"prompt":"hey"}'), ("x/2.txt", b"two"), ("x/2.prompt.txt", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "b.tar").write_bytes(b"junk" * 300)
    rows = tar_samples(spark, str(tmp_path / "*.tar")).collect()
    good = sorted((r["sample_idx"], r["key"], {k: bytes(v) for k, v in r["members"].items()}) for r in rows if r["error"] is None)
    assert good == [(0, "x/1", {"jpg": b"p", "json": b'{"prompt":"hey"}'}), (1, "x/2", {"txt": b"two", "prompt.txt": b"no"})]
    assert sum(r["error"] is not None for r in rows) == 1
    df = tar_samples(spark, str(tmp_path / "a.tar"))
    assert sorted(r[0] for r in df.select(E.member_caption(F.col("members"))).collect()) == ["hey", "two"]


def test_parquet_and_prompts(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quillpack.sources.readers import json_lines, parquet_rows, row_groups
    from quillpack.sources.shards import split_name

    pq.write_table(pa.table({"x": list(range(10))}), tmp_path / "a.parquet", row_group_size=4)
    assert sorted((r["x"], r["row_index"]) for r in parquet_rows(spark, str(tmp_path / "a.parquet")).collect()) == [(i, i) for i in range(10)]
    assert [(r["row_group"], r["first_row"], r["n_rows"]) for r in row_groups(spark, str(tmp_path / "a.parquet")).orderBy("row_group").collect()] == [(0, 0, 4), (1, 4, 4), (2, 8, 2)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 3}\n')
    got = [r["value"] for r in json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()]
    assert sorted(v["a"] for v in got if v is not None and v["a"] is not None) == [1, 3]
    assert split_name("a/b.c/d.prompt.txt") == ("a/b.c/d", "prompt.txt")


def test_stream_goes_on_across_batches(spark, tmp_path):
    from quillpack.streaming.packer import stream_packs

    src, out = str(tmp_path / "in"), "packs"
    spark.createDataFrame([("p", i, 30) for i in range(5)], "packer string, seq long, est long").coalesce(1).write.parquet(src)
    q = stream_packs(spark.readStream.schema("packer string, seq long, est long").parquet(src), 100).writeStream.format("memory").queryName(out).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    spark.createDataFrame([("p", 5 + i, 30) for i in range(3)], "packer string, seq long, est long").coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert [r["pack"] for r in spark.sql("select * from packs order by seq").collect()] == [0, 0, 0, 1, 1, 1, 2, 2]


def test_noise_stays_in_range(spark):
    from quillpack.operators.noise import adapted_length, masked_positions

    rows = spark.range(200).select(F.col("id"), (F.col("id") % 7 + 1).alias("n"))
    for r in rows.select("n", masked_positions(F.col("n"), 1, "id").alias("m"), adapted_length(F.col("n"), 1, "id").alias("a")).collect():
        assert r["m"]["positions"] and all(0 <= p < r["n"] for p in r["m"]["positions"])
        assert 0.001 <= r["m"]["p"] <= 1 and 1 <= r["a"] <= 2 * r["n"]


def test_embedding(spark):
    got = one(spark, mathx.timestep_embedding(F.lit(2.0), 5))[0]
    args = [2.0 * math.exp(-math.log(10000.0) * i / 2) for i in range(2)]
    assert got == pytest.approx([math.cos(a) for a in args] + [math.sin(a) for a in args] + [0.0])


def test_images_of_an_edit_are_not_capped(spark):
    from quillpack.operators import elements as E

    members = {f"image_{i}.jpg": "x" for i in (*range(1, 101, 3), 2)} | {"output.jpg": "x", "image_0.jpg": "x", "image_x.jpg": "x", "txt": "x"}
    got = spark.createDataFrame([("say <image>it ", members)], "t string, m map<string,string>").select(E.plain_edit(F.col("t"), F.col("m")).alias("e")).first()["e"]
    assert [e["text"] for e in got] == [f"image_{i}" for i in sorted((*range(1, 101, 3), 2))] + ["say it", "output"]


def test_masks_are_drawn_until_one_is_hit(spark):
    """By the same draws; attempts beyond those that the plan spells out happen."""
    import hashlib

    from quillpack.operators import noise as N

    def draw(*keys):
        return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 2**32

    got = spark.range(3000).select("id", N.masked_positions(F.lit(1).cast("long"), 9, "id").alias("m")).collect()
    most = 0
    for r in got:
        a = 0
        while not draw(9, "mask/u", a, r["id"], 0) < (p := 0.999 * draw(9, "mask/t", a, r["id"]) + 0.001):
            a += 1
        most = max(most, a)
        assert r["m"]["positions"] == [0] and abs(r["m"]["p"] - p) < 1e-12
    assert most > N.ATTEMPTS + 2


def test_edit_pairs_need_all_members(spark):
    from quillpack.operators import elements as E

    cases = {("src_img.jpg",): None, ("src_img.jpg", "edited_img.jpg", "edited_prompt.txt"): "pair", ("1.0.jpg", "2.jpg", "json"): "numbered", ("1.0.jpg", "2.jpg", "1.1.jpg", "json"): None, ("output.jpg",): "multi", ("1.0.jpg", "2.jpg"): None}
    rows = [(dict.fromkeys(k, "x"), v) for k, v in cases.items()]
    for r in spark.createDataFrame(rows, "m map<string,string>, want string").select(E.edit_format(F.col("m")).alias("got"), "want").collect():
        assert r["got"] == r["want"]
