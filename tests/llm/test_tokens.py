"""Ids, planes, packing, counts."""

import collections
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillpack.llm import planes
from quillpack.llm.packing import due, pack, rates, schedule
from quillpack.llm.token_counts import count_tokens
from quillpack.llm.tokens import PieceEncoder

from .conftest import rows, texts

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def library(ts):
    from tokenizers import Tokenizer

    return [np.array(x.ids, "<u4") for x in Tokenizer.from_file(BPE).encode_batch([t or "" for t in ts], add_special_tokens=False)]


def odd(n, chars):
    rnd = random.Random(1)
    return ["".join(rnd.choice(chars) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_pieces_equal_the_library():
    ts = [t or "" for t in texts()] + odd(2000, " ab\n\t.,'’s1é日　 ᠎\x1c\x85<|endoftext|>")
    want = library(ts)
    for e in (PieceEncoder(BPE), PieceEncoder(BPE, words=10)):
        for size in (1, 7, len(ts)):
            for i in range(0, len(ts) if size > 1 else 300, size):
                flat, n = e.encode(ts[i : i + size])
                assert n.tolist() == list(map(len, want[i : i + size])) and (flat == np.concatenate(want[i : i + size])).all()
        flat, n = e.encode(ts, 2)
        assert (flat == np.concatenate([np.append(x, 2) for x in want])).all() and n.sum() == len(flat)
        assert len(e.known) <= e.most and len(e.encode([])[0]) == 0


def packed_memory():
    """MB that a process of its own takes for blobs of 32 MB of texts, besides library and vocabulary."""
    import resource
    import types

    import pyarrow as pa

    from quillpack.llm import packing

    packing.map_arrow, packing.materialise = lambda df, f, ddl: f, lambda f, name: f
    packing.TaskContext = types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0))
    run = packing.bundles(types.SimpleNamespace(select=lambda *c: None), BPE)
    rnd = random.Random(5)
    stock = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(700_000)]

    def batch(n, words):
        return pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "source": ["a"] * n, "text": [" ".join(rnd.choices(stock, k=words)) for _ in range(n)]})

    list(run([batch(1, 1)]))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids = sum(len(b["ids"][0]) // (4 if b["wide"][0] else 2) for b in run(batch(1100, 1000) for _ in range(4)))
    assert ids > 4_000_000
    print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)


def test_encoding_takes_bounded_memory():
    # a process of its own, as a worker is
    got = subprocess.run([sys.executable, "-c", "from tests.llm.test_tokens import packed_memory; packed_memory()"], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(got.stdout) < 130  # 191 with slices of 4 MB and 600 000 words remembered, 77 now


def test_null_source_is_its_own(spark):
    df = spark.createDataFrame([(i, (None, "", "b")[i % 3], "one two " * 400) for i in range(30)], "doc_id long, source string, text string")
    got = collections.Counter()
    for p in pack(df, BPE, 1).collect():
        got[p["source"]] += p["length"]
    assert set(got) == {None, "", "b"} and len(set(got.values())) == 1


def test_many_short_documents_in_one_segment(spark):
    df = spark.range(40000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    got = planes.token_files(df, BPE, 2).agg(F.count("*"), F.sum("n_tokens"), F.max("start")).first()
    assert tuple(got) == (40000, 120000, 119997)


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rnd = np.random.default_rng(1)
    for ids in (np.zeros(0, "<u4"), np.zeros(5, "<u4"), rnd.integers(0, 1 << 32, 1001, dtype="<u4"), rnd.integers(0, 50000, 4096).astype("<u4")):
        index, payload = planes.encode_blocks(ids, 256, bits)
        assert (planes.decode_blocks(index, payload) == ids).all()
        assert [b["first"] for b in index] == list(range(0, len(ids), 256))


def test_files(spark, docs, none, tmp_path):
    for bits in (False, True):
        got = sorted(tuple(r)[:4] for r in planes.token_files(docs, BPE, 2, bits).collect() if r["doc_id"] is not None)
        want, start = [], 0
        order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
        for r, x in zip(order, library([r[1] for r in order]), strict=True):
            ids = np.append(x, 2).astype("<u4")
            want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert got == sorted(w for w in want if w[0] is not None)
    planes.write_ids(docs, str(tmp_path / "f"), BPE, 2, block=64, segment=500)
    back = {r["doc_id"]: r["ids"] for r in planes.read_ids(spark.read.parquet(str(tmp_path / "f"))).collect()}
    assert back == {r[0]: np.append(x, 2).astype("<u4").tobytes() for r, x in zip(rows(), library([r[1] for r in rows()]), strict=True)}
    assert planes.token_files(none, BPE).count() == 0


def test_packing(docs, none):
    pieces = pack(docs, BPE, 1).collect()
    whole = collections.defaultdict(list)
    for r, x in zip(rows(), library([r[1] for r in rows()]), strict=True):
        whole[r[0]].append(np.append(x, 1).astype("<u4"))
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(whole)
    for k, ps in by_doc.items():
        assert sum(p["length"] for p in ps) == sum(map(len, whole[k]))
        if len(whole[k]) == 1:
            at, ids = 0, whole[k][0]
            for p in sorted(ps, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == len(ids)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 2048 or at & (at - 1) == 0
    assert pack(none, BPE).count() == 0


def test_mixture_holds_at_every_window():
    rnd = random.Random(2)
    sources = [rnd.choice("aaabbc") for _ in range(3000)]
    lengths = [rnd.randrange(1, 900) for _ in sources]
    total = sum(lengths)
    share = {s: sum(n for x, n in zip(sources, lengths, strict=True) if x == s) / total for s in "abc"}
    seen, n = collections.Counter(), 0
    out = list(schedule(sources, lengths, share, {}))
    last = out[-1][3]
    for i, _, length, seq, _, _ in out:
        seen[sources[i]] += length
        n += length
        if seq < last - 12:
            assert all(abs(seen[s] - share[s] * n) < 2 * 512 + 2048 for s in "abc")
    assert n == total
    # a deficit from before is made up for
    owed = list(schedule(sources, lengths, share, {"c": 5000.0, "a": -5000.0}))
    first = [sources[i] for i, _, _, seq, _, _ in owed if seq < 2]
    assert set(first) == {"c"}
    # targets that aren't the corpus' own hold while all sources last
    even = collections.Counter()
    for i, _, length, seq, _, _ in schedule(sources, lengths, {s: 1 / 3 for s in "abc"}, {}):
        if seq < 60:
            even[sources[i]] += length
    assert max(even.values()) - min(even.values()) < 2 * (512 + 2048)


def test_counts_equal_the_library(docs, none):
    import sentencepiece

    from quillpack.llm import transducer

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    ts = [t or "" for t in texts()] + odd(3000, " ▁ab\nthe.inр日é\"()\t<s>") + [" " * n + "the" for n in range(40)] + [" " * n for n in range(40)]
    want = list(map(len, model.encode(ts)))
    t = transducer.compiled(PIECE)
    assert t.counts(ts) == want
    # maps of chunks compose to the same, wherever the text is cut
    for size in (1, 3, 50):
        for x, n in zip(ts[:300], want[:300], strict=True):
            if x:
                marked = transducer.MARK + x.replace(" ", transducer.MARK)
                whole = t.scan([t.chunk(marked[i : i + size]) for i in range(0, len(marked), size)])
                assert t.run(whole.head).count[-1] + whole.count == n
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs, PIECE, 50).collect())
    assert got == sorted((r[0] or 0, len((r[1] or "").encode()), (n := len(model.encode(r[1] or ""))), n > 50) for r in rows())
    assert count_tokens(none, PIECE).count() == 0


def test_chunks_side_by_side(monkeypatch):
    """Runs about and over the length at which chunks are cut, characters without an entry, and more chunks than lanes."""
    import sentencepiece

    from quillpack.llm import transducer

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rnd = random.Random(11)
    runs = ["".join(rnd.choice(a) for _ in range(n)) for a in ("a", "etaoinsr", "日本語の文", "é\u0301ß\U0001f600x", "-=#/.") for n in (1, 62, 63, 64, 65, 127, 129, 700)]
    ts = [*runs, " ".join(runs), "  ".join(runs), "a" * 20000, "", " ", "\u2581"]
    monkeypatch.setattr(transducer, "LANES", 7)
    assert transducer.compiled(PIECE).counts(ts) == list(map(len, model.encode(ts)))
    assert transducer.compiled(PIECE).counts([]) == []
    table, keys = transducer.Table(4), np.array(rnd.sample(range(1, 1 << 40), 5000), "i8")
    for a in range(0, 5000, 700):
        table.put(keys[a : a + 700], np.arange(a, min(a + 700, 5000), dtype="i4"))
    assert table.get(keys).tolist() == list(range(5000)) and (table.get(np.setdiff1d(np.arange(1, 1000), keys)) == -1).all()


@pytest.mark.parametrize("target", [None, {"a": 3.0, "b": 1.0}])
def test_mixture_of_input_sorted_by_source(spark, target):
    """A task for each source, and a document longer than a bundle."""
    rnd = random.Random(7)
    text = lambda n: " ".join(rnd.choice(["one", "two", "three"]) for _ in range(n))
    sizes = [("a", 300)] * 120 + [("b", 200)] * 200 + [("c", 30000)] + [("c", 10)] * 40
    own = [(i, s, text(n)) for i, (s, n) in enumerate(sizes)]
    df = spark.createDataFrame(own, "doc_id long, source string, text string").repartitionByRange(3, "source")
    for size in ({}, {"size": 16384}):
        pieces = sorted(pack(df, BPE, 1, target, **size).collect(), key=lambda p: (p["sequence_id"], p["offset"]))
        whole, parts = collections.Counter(), collections.defaultdict(list)
        for p in pieces:
            whole[p["source"]] += p["length"]
            parts[p["doc_id"]].append(p)
        for i, ps in parts.items():
            ids, at = np.append(library([own[i][2]])[0], 1).astype("<u4") if i % 50 == 0 else None, 0
            for p in sorted(ps, key=lambda p: p["start"]):
                assert p["start"] == at
                assert ids is None or p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == ps[0]["doc_tokens"]
        assert set(parts) == set(range(len(sizes)))
        share = {s: n / whole.total() for s, n in whole.items()} if target is None else {"a": 0.75, "b": 0.25, "c": 0.0}
        lasts = min(whole[s] / share[s] for s in "abc" if share[s])
        seen, n = collections.Counter(), 0
        for p in pieces:
            seen[p["source"]] += p["length"]
            n += p["length"]
            if n <= lasts - 8192:
                assert all(abs(seen[s] - share[s] * n) < 2 * 512 + 2048 for s in "abc")


def test_deficits_are_carried_from_bundle_to_bundle(spark):
    """Every bundle ends with what one pass over all of them would owe: each source has served what it is due, and at most a packet more."""
    rnd = random.Random(11)
    own = [(i, rnd.choice("aaabbc"), " ".join(rnd.choice(["one", "two", "three"]) for _ in range(rnd.choice([5, 200, 900, 3000])))) for i in range(400)]
    df = spark.createDataFrame(own, "doc_id long, source string, text string").repartition(5)
    size = 8 * 2048
    pieces = sorted(pack(df, BPE, 1, size=size).collect(), key=lambda p: (p["sequence_id"], p["offset"]))
    held = collections.Counter()
    for p in pieces:
        held[p["source"]] += p["length"]
    held = dict(sorted(held.items()))
    rate, start, times = rates(held, None, size)
    bundles = [p["sequence_id"] >> 24 for p in pieces]
    assert bundles[-1] == len(times) - 1 > 15
    served, seen, over = collections.Counter(), 0, 0
    for k in range(len(times)):
        for p, b in zip(pieces, bundles, strict=True):
            if b == k:
                served[p["source"]] += p["length"]
        owed = {s: int(due(held[s], rate[s], start[s], times[k])) - served[s] for s in held}
        assert all(-512 < x <= 0 for x in owed.values())
        over += sum(x < 0 for x in owed.values())
    assert over > 20 and served == held
    # at every window of the whole output, over the seams between bundles too
    served, seen = collections.Counter(), 0
    for p in pieces:
        served[p["source"]] += p["length"]
        seen += p["length"]
        assert all(abs(served[s] - seen * held[s] / sum(held.values())) < 2 * 512 + 2048 for s in held)
    # the pieces of a document follow each other, cut at packets alone or where a window ends
    parts = collections.defaultdict(list)
    for p in pieces:
        parts[p["doc_id"]].append((p["start"], p["length"], p["doc_tokens"], p["offset"] + p["length"] == p["sequence_length"]))
    for ps in parts.values():
        ps.sort()
        assert ps[0][0] == 0 and sum(n for _, n, _, _ in ps) == ps[0][2]
        assert all(a + n == b for (a, n, _, _), (b, _, _, _) in zip(ps, ps[1:]))
