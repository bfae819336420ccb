"""The registered queries on a small table: rows, folds, flags and production parameters."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from quillpack.llm import queries as q

from .conftest import prose, texts

COLUMNS = {
    "op1_bit_planes": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op2_winnowing": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op3_crf_languages": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_byte_index_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_suffix_trees": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op6_weak_supervision": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_matroska": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op9_log_bilinear": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op10_transducer_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


def table():
    rnd = random.Random(31)
    stock = {"en": ["the", "house", "is", "near", "water"], "fr": ["la", "maison", "est", "près", "eau"], "de": ["das", "Haus", "ist", "nahe", "Wasser"]}
    out = []
    for i in range(150):
        lang = ("en", "fr", "de")[i % 3]
        words = [*prose(rnd, 30, stock[lang]).split(" "), *(["vile", "scum"] if i % 5 == 0 else []), f"n{i}"]
        rnd.shuffle(words)
        out.append((100 + i, " ".join(words), lang, ("hot", "b")[i % 7 == 0], int(i % 5 == 0)))
    out += [(1000 + i, t, None, None, 0) for i, t in enumerate(texts())]
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queries"))
    rows = table()
    spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, _, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[-3][1].split()[:12])), (2, None), (3, "house near")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", COLUMNS)
def test_rows_columns_folds(spark, sf, name):
    df = getattr(q, name)(spark, sf)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    got = {r["doc_id"]: r for r in df.collect()}
    rows = {i: t or "" for i, t, _, _, _ in table()}
    assert sorted(got) == sorted(rows)
    folds = {"op3_crf_languages": (4, 2), "op6_weak_supervision": (3, 1), "op9_log_bilinear": (10, 0)}
    if name in folds:
        n, k = folds[name]
        assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % n == k) for i, r in got.items())
    CHECKS.get(name, lambda got, rows: None)(got, rows)


def encodings(rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: np.array([*t.encode(x, add_special_tokens=False).ids, end], "<u4") for i, x in rows.items()}


def planes(got, rows):
    start = 0
    for i, ids in sorted(encodings(rows, 2).items()):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def languages(got, rows):
    letterless = [i for i, t in rows.items() if not any(c.isalpha() for c in t)]
    assert letterless and all(got[i]["lang_pred"] == "und" for i in letterless)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "de", "und") for r in got.values())
    own = [(lang, got[i]["lang_pred"]) for i, _, lang, _, _ in table() if lang and got[i]["held_out"]]
    assert len(own) > 20 and sum(a == b for a, b in own) >= 0.9 * len(own)


def toxicity(got, rows):
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def media(got, rows):
    for i, t in rows.items():
        raw = t.encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    by_text = collections.defaultdict(set)
    for i, t in rows.items():
        by_text[t].add(tuple(got[i])[1:])
    assert all(len(x) == 1 for x in by_text.values())


def scores(got, rows):
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for i, t in rows.items()}
    counts = collections.Counter(x for i, w in words.items() if zlib.crc32(str(i).encode()) % 10 for x in w)
    n, v = counts.total(), len(counts)
    for i, w in words.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), n)
        base = math.fsum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def token_counts(got, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, t in rows.items():
        n = len(model.encode(t))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(t.encode()), n, n > 4096)
    assert any(r["over_limit"] for r in got.values())


CHECKS = {"op1_bit_planes": planes, "op3_crf_languages": languages, "op6_weak_supervision": toxicity, "op8_matroska": media, "op9_log_bilinear": scores, "op10_transducer_counts": token_counts}


def test_packing_query(spark, sf):
    """The end id is 1, every id of every document lies in one piece."""
    whole = encodings({i: t or "" for i, t, _, _, _ in table()}, 1)
    parts = collections.defaultdict(list)
    for p in q.op7_mixture_packing(spark, sf).collect():
        parts[p["doc_id"]].append(p)
    assert set(parts) == set(whole)
    for i, ps in parts.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(whole[i]))
            assert p["ids_crc32"] == zlib.crc32(whole[i][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(whole[i])
