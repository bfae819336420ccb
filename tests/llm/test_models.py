"""Language identification, toxicity, language model, media, pipeline."""

import collections
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillpack.llm import bilinear, langcrf, matroska, toxicity

from .conftest import EXTRA, rows


def test_forward_backward_is_exact():
    """Against all label sequences."""
    import itertools

    rnd = np.random.default_rng(0)
    scores, moves, first = rnd.normal(size=(2, 4, 3)), rnd.normal(size=(3, 3)), rnd.normal(size=3)
    lengths = np.array([4, 2])
    p, _ = langcrf.posteriors(scores, moves, first, lengths)
    for r, n in enumerate(lengths):
        total, want = 0.0, np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            w = math.exp(first[y[0]] + sum(scores[r, t, y[t]] for t in range(n)) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
            total += w
            for t in range(n):
                want[t, y[t]] += w
        assert np.allclose(p[r, :n], want / total)


def test_messages_pass_from_run_to_run():
    """Runs of any length give the posteriors of whole texts, one text of which is much longer than the others."""
    rnd = np.random.default_rng(4)
    sizes = np.array([0, 5, 64, 1, 0, 201, 3])
    scores, moves, first = rnd.normal(size=(int(sizes.sum()), 3)) * 2, rnd.normal(size=(3, 3)) * 2, rnd.normal(size=3)
    ends = np.cumsum(sizes)
    for run in (1, 2, 7, 64, 1000):
        p = langcrf.marginals(scores, sizes, moves, first, run)
        for n, e in zip(sizes, ends, strict=True):
            if n:
                want, _ = langcrf.posteriors(scores[None, e - n : e], moves, first, np.array([n]))
                assert np.allclose(p[e - n : e], want[0])
    assert len(langcrf.marginals(scores[:0], np.zeros(2, "i8"), moves, first)) == 0


def test_every_letter_of_a_long_word_counts():
    own = language_rows()
    field = langcrf.fit([(t, k) for _, t, k in own])
    de = "".join(own[0][1].split() * 20)
    fr = "".join(own[2][1].split() * 2)
    got = dict(langcrf.Labeller(field).predict([fr + de + fr]))
    assert list(got) == [own[0][2]] and len(langcrf.WORD.findall(de)) > 10


def test_sample_is_bounded_when_an_id_repeats(spark):
    """300 documents of each language at most, though one id has most of the rows."""
    own = language_rows(60)
    df = spark.createDataFrame([(r[0], *r[1:]) for r in own] + [(own[0][0], f"{own[0][1]} {i}", own[0][2]) for i in range(400)], "doc_id long, text string, lang string")
    seen = []
    fit, langcrf.fit = langcrf.fit, lambda rows: seen.append(rows) or fit(rows)
    try:
        langcrf.sample(df, most=7)
    finally:
        langcrf.fit = fit
    assert collections.Counter(k for _, k in seen[0]) == {"de": 7, "en": 7, "fr": 7}


def language_rows(n=120):
    rnd = random.Random(3)
    stock = {"en": ["the", "thing", "with", "ation", "onth", "were"], "de": ["der", "schicht", "keit", "ung", "ich", "über"], "fr": ["le", "eaux", "que", "ment", "où", "été"]}
    return [(i, " ".join(rnd.choice(stock[k]) + rnd.choice(stock[k]) for _ in range(30)), k) for i in range(n) for k in [sorted(stock)[i % 3]]]


def test_languages(spark, docs, none):
    own = language_rows()
    df = spark.createDataFrame([(*r, 0.1, "und") for r in own], "doc_id long, text string, lang string, score double, lang_pred string")
    got = {r["doc_id"]: r for r in langcrf.languages(df, df.where("doc_id % 4 <> 0")).collect()}
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 for i, _, k in own)
    out = {r["doc_id"]: r for r in langcrf.languages(docs, df).collect()}
    assert len(out) == len({r[0] for r in rows()})
    for r in rows():
        letters = any(c.isalpha() for c in r[1] or "")
        assert (out[r[0]]["lang_pred"] == "und") == (not letters)
    assert {r["lang_pred"] for r in langcrf.languages(docs, none).collect()} == {"und"}
    assert langcrf.languages(none, df).count() == 0


def test_code_switches_are_labelled_by_word():
    own = language_rows()
    field = langcrf.fit([(t, k) for _, t, k in own])
    en, fr = own[1][1], own[2][1]
    got = langcrf.Labeller(field).label([en + " " + fr])[0]
    names = [field.languages[int(p.argmax())] for _, p in got]
    want = [own[1][2]] * 30 + [own[2][2]] * 30
    assert sum(a == b for a, b in zip(names, want, strict=True)) >= 57
    assert all(field.moves[k, k] > field.moves[k].mean() for k in range(3))


def toxic_rows(n=900):
    rnd = random.Random(5)
    plain, bad = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)], ["wretch", "slimeball", "dolt"]
    out = []
    for i in range(n):
        y = i % 5 == 0
        w = [rnd.choice(plain) for _ in range(60)]
        if y:
            for _ in range(rnd.randrange(1, 4)):
                w[rnd.randrange(60)] = rnd.choice([*bad, "zorg" + rnd.choice(plain)])
        out.append((i, " ".join(w), int(y)))
    return out


def test_toxicity(spark, docs, none):
    own = toxic_rows()
    df = spark.createDataFrame([(i, t, 9.9, "p") for i, t, _ in own], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in own], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxic_scores(df, labels.where("doc_id % 3 <> 1")).collect()}
    held = [(i, y) for i, _, y in own if i % 3 == 1]
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.97
    assert not any(got[i]["predicted"] for i, y in held if not y)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    left = toxicity.without_toxic(df, labels.where("doc_id % 3 <> 1"))
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if not r["predicted"]}
    # nothing to learn from; texts of all kinds; no texts
    assert toxicity.toxic_scores(docs, labels.limit(0)).count() == len(rows())
    assert toxicity.without_toxic(docs, labels, train=df).count() == len(rows())
    assert toxicity.toxic_scores(none, labels, train=df).count() == 0


def votes(rnd, y, hit, false):
    return np.where(y, rnd.random(len(y)) < hit, rnd.random(len(y)) < false)


def test_label_model_prefers_accurate_voters():
    rnd = np.random.default_rng(3)
    y = rnd.random(4000) < 0.2
    x = np.stack([votes(rnd, y, 0.7, 0.01), votes(rnd, y, 0.6, 0.02), votes(rnd, y, 0.5, 0.4)], 1)
    noisy = y ^ (rnd.random(len(y)) < 0.05)  # labels of which one in 20 is wrong
    m = toxicity.label_model(x, noisy)
    odds = m.yes / m.no
    assert odds[0] > odds[1] > 5 > 2 > odds[2]
    p = m.posterior(x)
    assert (p[y & (x[:, 0] | x[:, 1])] > 0.7).mean() > 0.95 and (p[~y & ~x[:, 0] & ~x[:, 1]] < 0.3).all()
    # by its definition: the odds of who votes, in parts, on the base
    for row, q in zip(x[:40], p[:40], strict=True):
        z = m.base / (1 - m.base) * math.prod((m.yes[k] / m.no[k]) ** m.share[k] for k in range(3) if row[k])
        assert q == pytest.approx(z / (1 + z))
    # a voter that votes three times over has one vote
    many = toxicity.label_model(np.column_stack([x, x[:, 2], x[:, 2]]), noisy)
    assert many.share[[2, 3, 4]].sum() == pytest.approx(1, abs=0.05) and (many.share[:2] == 1).all()


def test_toxic_features_and_scores_by_brute_force(spark):
    own = toxic_rows()
    model = toxicity.fit([t for _, t, _ in own], [y for *_, y in own])
    assert {f.lstrip("^")[:3] for f, _ in model.weights} >= {"wre", "sli", "dol", "zor"}
    df = spark.createDataFrame([(i, t) for i, t, _ in own] + [(-1, None), (-2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(df, model).collect()}
    for i, t, _ in [*own, (-1, "", 0), (-2, "", 0)]:
        words = [w.lower() for w in t.split() if w.isalpha()]
        n = lambda f: sum(w.startswith(f[1:]) if f[0] == "^" else w == f for w in words)
        z = model.bias + sum(w for (f, k), w in model.weights.items() if n(f) >= (k if k == 1 else k * max(1, len(words) / toxicity.PER)))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)))
    hashed = toxicity.Features()
    text = own[0][1] + " " + " ".join(["again"] * 3)
    names = {(f, k) for w in text.split() for f in toxicity.Features.names(w) for k in toxicity.TIMES}
    found = toxicity.Index([*names, ("^zzz", 1)]).found(text)
    assert ("again", 3) in found and len(found) == len(hashed.of(text)) and len(hashed.of("")) == 0


def test_unborne_labels_are_not_learned():
    """Labels of class 1 on texts like all others."""
    own = toxic_rows()
    wrong = [1 if i % 25 == 3 else y for i, _, y in own]
    model = toxicity.fit([t for _, t, _ in own], wrong)
    score = lambda t: 1 / (1 + math.exp(-model.bias - sum(model.weights[f] for f in model.index().found(t))))
    assert all(score(t) < 0.7 for i, t, y in own if not y)
    assert np.mean([score(t) >= 0.7 for _, t, y in own if y]) > 0.95


def test_different_texts_of_common_words_all_count():
    """Texts over a small vocabulary are no copies; those that differ in a word or two are."""
    rnd = random.Random(8)
    stock = ["".join(rnd.choice("abcdef") for _ in range(4)) for _ in range(300)]
    texts = [" ".join(rnd.choice(stock) for _ in range(80)) for _ in range(200)]
    assert len(set(toxicity.copies(texts))) == 200
    near = [f"{t} more{i}" for i, t in enumerate(texts)]
    group = toxicity.copies(texts + near)
    assert all(group[i] == group[i + 200] for i in range(200)) and len(set(group)) == 200
    assert toxicity.copies([]) == [] and len(set(toxicity.copies(["", "", "a"]))) == 3


def test_language_model(spark, docs, none):
    held = "crc32(cast(doc_id as string)) % 10 = 0"
    got = collections.defaultdict(list)
    for r in bilinear.text_scores(docs, held).collect():
        got[r["doc_id"]].append(r)
    own = [(r[0], [*(r[1] or "").encode().lower().split(), b" "], None if r[0] is None else zlib.crc32(str(r[0]).encode()) % 10 == 0) for r in rows()]
    c = collections.Counter()
    for _, w, h in own:
        if h is False:
            c.update(w)
    n, v = sum(c.values()), len(c)
    for i, w, h in own:
        for r in got[i]:
            base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h is not False, len(w), sum(c[x] > 0 for x in w), n)
            assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert sum(map(len, got.values())) == len(own)
    assert bilinear.text_scores(none, held).count() == 0
    assert bilinear.text_scores(docs, "true").count() == len(own)


def test_tokens_are_those_of_the_definition():
    import pyarrow as pa

    ts = [r[1] or "" for r in rows()] + ["", " ", "\x0b\x0c a", "x\x1cy \x85 é\u2003Z\tÀB", "  \n"]
    for own in (ts, ts[:1], ["", ""], [" "]):
        words, where, sizes = bilinear.lexed(pa.array(own, pa.large_string()))
        words = [*words.to_pylist(), bilinear.END]
        want = [[*t.encode().lower().split(), bilinear.END] for t in own]
        assert [words[i] for i in where] == [w for ws in want for w in ws] and sizes.tolist() == list(map(len, want))


def test_probabilities_add_up_and_training_helps():
    rnd = random.Random(1)
    chain = {0: [2, 3], 1: [2], 2: [3, 3, 3, 4], 3: [4, 4, 1], 4: [1, 2, 2]}
    ids = [1]
    for _ in range(60000):
        ids.append(rnd.choice(chain[ids[-1]]))
    ids = np.array(ids)
    by_class = np.bincount(ids, minlength=5).astype(float)
    ends = np.array([len(ids)])
    t, a, b = bilinear.contexts(ids, ends)
    stream = (np.stack([t, a, b])[:, i : i + 2000] for _ in range(4) for i in range(0, len(ids), 2000))
    model, _, seen = bilinear.train(bilinear.start(by_class, 8), by_class, stream, 1)
    tables = bilinear.Tables(model)
    every = np.arange(5)
    for x in range(5):
        for y in range(5):
            p = 10 ** tables.log10(every, np.full(5, x), np.full(5, y))
            z = np.exp([(model.c[0] * model.r[x] + model.c[1] * model.r[y]) @ model.q[k] + model.bias[k] for k in range(5)])
            assert np.allclose(p, z / z.sum(), atol=1e-5)
    trained = tables.log10(t, a, b).mean()
    assert seen == 4 * len(ids) and trained > np.log10(by_class[t] / len(ids)).mean() + 0.1


def test_batches_hold_every_token_once():
    rnd = np.random.default_rng(5)
    texts = [np.append(rnd.integers(1, 9, n), 0).astype("u2") for n in (0, 40000, 3, 2, 50000, 0)]
    got = np.concatenate(list(bilinear.batches_of(x.tobytes() for x in texts)), 1)
    ids = np.concatenate(texts).astype("i8")
    assert (got == np.stack(bilinear.contexts(ids, np.cumsum(list(map(len, texts)))))).all()


def test_scores_depend_on_rows_alone(spark):
    """Several shards; other files, order and partitions; a brute-force softmax; better than single tokens' shares."""
    rnd = random.Random(6)
    stock = {k: [f"{k}{rnd.randrange(90)}{'xyz'[k % 3]}" for _ in range(60)] for k in range(4)}
    own = [(i, " ".join(rnd.choice(stock[i % 4]) for _ in range(40)) + (f" rare{i}" if i % 5 == 0 else "")) for i in range(600)]
    df = spark.createDataFrame(own, "doc_id long, text string")
    seen, learn = [], bilinear.learn

    def kept(scored, h, **more):
        seen.append((h, learn(scored, h, **more)))
        return seen[-1][1]

    bilinear.learn = kept
    try:
        one = {r["doc_id"]: r for r in bilinear.text_scores(df.repartition(7), "doc_id % 10 = 0", shard=3000).collect()}
        two = {r["doc_id"]: r for r in bilinear.text_scores(df.orderBy(F.desc("doc_id")).coalesce(2), "doc_id % 10 = 0", shard=3000).collect()}
    finally:
        bilinear.learn = learn
    assert all(r["score"] == pytest.approx(two[i]["score"], abs=1e-9) for i, r in one.items())
    held = [r for r in one.values() if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held) > 0.1
    h, m = seen[0]
    c = collections.Counter(w for i, t in own if i % 10 for w in [*t.split(), "\n"])
    suffix = lambda w: 1 + h.own + zlib.crc32(w.encode()[-3:]) % bilinear.SUFFIXES
    classes = {w.decode(): k + 1 for k, w in enumerate(h.words[: h.own])}
    kinds = collections.Counter(suffix(w) for w in c if w not in classes and w != "\n")
    mass = collections.Counter()
    for w, n in c.items():
        if w not in classes and w != "\n":
            mass[suffix(w)] += n
    for i, t in own[:40]:
        a = b = 0
        want = 0.0
        for w in [*t.split(), "\n"]:
            k = 0 if w == "\n" else classes.get(w, suffix(w))
            z = (m.c[0] * m.r[a] + m.c[1] * m.r[b]) @ m.q.T + m.bias
            want += (z[k] - np.log(np.exp(z).sum())) / math.log(10) + (math.log10((c[w] + 0.1) / (mass[k] + 0.1 * (kinds[k] + 1))) if k > h.own else 0)
            a, b = k, a
        assert one[i]["score"] == pytest.approx(want, abs=1e-3)


def test_head_is_filled_when_counts_are_equal(spark):
    df = spark.createDataFrame([(" ".join(f"t{i}" for i in range(3000)),)], "text string")
    h = bilinear.head(bilinear.token_counts(df, 3), most=1000, own=100)
    assert 800 < len(h.words) < 1200 and h.own == 100 and h.total == 3001 and h.ends == 1
    assert h.by_class().sum() == 3001 and h.kinds.sum() == 2900


def test_contexts_begin_anew_with_each_text():
    t, a, b = bilinear.contexts(np.array([5, 0, 6, 7, 0, 0]), np.array([2, 5, 6]))
    assert (a.tolist(), b.tolist()) == ([0, 5, 0, 6, 7, 0], [0, 0, 0, 0, 6, 0])


def test_media(spark, docs, none):
    got = sorted(map(tuple, matroska.media(docs).drop("feature").collect()), key=str)
    want = []
    for r in rows():
        raw = (r[1] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        file = matroska.mux(payload)
        want.append((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest()))
    assert got == sorted(want, key=str)
    assert matroska.media(none).count() == 0
    files = spark.createDataFrame([(1, matroska.mux(b"ab" * 96 * 700), "x"), (2, b"", "x"), (3, None, "x"), (4, b"\x1a\x45junk", "x"), (1, matroska.mux(b"c" * 192), "x")], "track long, f binary, error string")
    rows_ = matroska.packet_table(files, "f", "track").collect()
    assert collections.Counter(r["track_key"] for r in rows_) == {1: 701, 4: 1}
    assert [r["timestamp_ms"] for r in rows_ if r["track_key"] == 1][:3] in ([0.0, 24.0, 48.0], [0.0])


def test_frame_times_and_key_frames():
    p = matroska.parse(matroska.mux(b"z" * 192 * 700))["packets"]
    assert [ms for _, ms, *_ in p] == [24.0 * k for k in range(700)] and all(key for _, _, key, _, _ in p)
    solo = lambda *more: matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, b"\x81" + struct.pack(">hBB", 5, 4, 1) + b"abcd") + b"".join(more))
    refers, lasts = matroska.element(matroska.REFERENCE, b"\xff"), matroska.unsigned(matroska.LASTS, 10)
    for default, second in ((b"", [100.0, 100.0]), (matroska.unsigned(matroska.DEFAULT, 3_000_000), [103.0, 103.0])):
        track = matroska.element(matroska.TRACKS, matroska.element(matroska.TRACK, matroska.unsigned(matroska.NUMBER, 1) + default))
        data = matroska.element(matroska.SEGMENT, track + matroska.element(matroska.CLUSTER, matroska.unsigned(matroska.TIME, 95) + solo() + solo(refers, lasts)))
        got = matroska.parse(data)["packets"]
        assert [key for _, _, key, _, _ in got] == [True, True, False, False]
        assert [got[1][1], got[3][1]] == (second if default else [100.0, 105.0]) and got[0][1] == got[2][1] == 100.0


def block(kind, frames, head):
    flags = {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}[kind]
    return matroska.element(matroska.SIMPLE, b"\x82" + struct.pack(">hB", -3, flags) + head + b"".join(frames))


def test_lacing_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 5, b"c" * 255, b"d" * 9]
    xiph = bytes([3]) + bytes([255, 45]) + bytes([5]) + bytes([255, 0])
    ebml = bytes([3]) + matroska.number_size(300) + struct.pack(">H", 0x4000 | (5 - 300 + 8191)) + struct.pack(">H", 0x4000 | (255 - 5 + 8191))
    fixed = [b"xy", b"zw"]
    cluster = matroska.unsigned(matroska.TIME, 1000) + block("xiph", frames, xiph) + block("ebml", frames, ebml) + block("fixed", fixed, b"\x01") + block("none", [b"solo"], b"")
    group = matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, b"\x81" + struct.pack(">hB", 7, 0) + b"grouped"))
    for unknown in (False, True):
        wrap = (lambda k, x: k.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + x) if unknown else matroska.element
        info = matroska.element(matroska.INFO, matroska.unsigned(matroska.SCALE, 2_000_000))
        data = matroska.element(matroska.EBML, b"") + wrap(matroska.SEGMENT, info + wrap(matroska.CLUSTER, cluster) + wrap(matroska.CLUSTER, matroska.unsigned(matroska.TIME, 2000) + group))
        p = matroska.parse(data)
        got = [data[first : first + n] for _, _, _, first, n in p["packets"]]
        assert got == frames + frames + fixed + [b"solo", b"grouped"]
        assert {(t, ms) for t, ms, *_ in p["packets"]} == {(2, 1994.0), (1, 4014.0)} and p["clusters"] == 2


@pytest.mark.parametrize("cut", [3, 30, 200, 400])
def test_damage_raises(cut):
    data = matroska.mux(b"x" * 1920)
    with pytest.raises(ValueError):
        matroska.parse(data[:cut])


def test_pipeline(spark, tmp_path):
    """Stages by brute force, over a small corpus with planted cases."""
    import corpus_pipeline as cp

    from .test_dedup import expected, fingerprint, groups, kept

    rnd = random.Random(12)
    own = toxic_rows(300)
    passage = " ".join(f"p{rnd.randrange(500)}" for _ in range(60))
    item = " ".join(f"q{rnd.randrange(500)}" for _ in range(30))
    docs, labels = [], []
    for i, t, y in own:
        if i % 41 == 1:
            t = f"{t} {passage} end{i}"
        if i % 43 == 2:
            t = f"start{i} {' '.join(item.split()[5:20])} {t}"
        docs.append((i, t, "en", "s" + str(i % 3), len(t)))
        labels.append((i, 1, y))
    docs += [(1000 + i, docs[i][1], "en", "copy", docs[i][4]) for i in range(20)] + [(2000, None, None, None, None), (2001, "", None, None, 0)]
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    df, seen = cp.documents(spark, sf), []
    for name, stage in cp.STAGES:
        df = cp.materialise(stage(spark, df, sf), name)
        seen.append([tuple(r) for r in df.collect()])
        if name != "packing":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i for i, _, y in own if not y}
    left = {r[0] for r in seen[0]}
    assert clean <= left and len(left & {i for i, _, y in own if y}) < 12
    rs = sorted(seen[0])
    g = groups([fingerprint(r[1]) for r in rs])
    assert sorted(r[0] for r in seen[1]) == sorted(rs[k][0] for k in set(g))
    rs = sorted(seen[1])
    assert {r[0]: r[1] for r in seen[2]} == {r[0]: " ".join(x for x, y in zip(w, gone, strict=True) if not y) if any(gone) else r[1] for r, (w, gone) in zip(rs, kept([r[1] for r in rs], 35), strict=True)}
    rs = sorted(seen[2])
    assert sorted(r[0] for r in seen[3]) == [r[0] for r, x in zip(rs, expected([r[1] for r in rs], [(1, item)]), strict=True) if not x[-1]]
    assert {r[0] for r in seen[4]} == {r[0] for r in seen[3]}
    assert cp.run(spark, sf).count() == len(seen[4])
    assert EXTRA
