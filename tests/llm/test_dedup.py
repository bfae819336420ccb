"""Near copies, passages, decontamination."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from quillpack.llm import decontaminate, shingles, simhash, suffixes
from quillpack.llm.components import components

from .conftest import prose, rows


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fingerprint(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values):
    """Classes of values within 3 bits, by brute force."""
    v = np.array(values, "u8")
    root = list(range(len(v)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 3).tolist():
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(v))]


def test_near_copies(docs, none):
    got = sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_copies(docs).collect())
    rs = rows()
    f = [fingerprint(r[1]) for r in rs]
    g = groups(f)
    least = {k: min(r[0] for r, x in zip(rs, g, strict=True) if x == k and r[0] is not None) if any(r[0] is not None for r, x in zip(rs, g, strict=True) if x == k) else None for k in g}
    assert got == sorted((r[0] or 0, f"{x:016x}", least[k]) for r, x, k in zip(rs, f, g, strict=True))
    assert simhash.near_copies(none).count() == 0


@pytest.mark.parametrize("long", [2048, 20, 4])
def test_links_join_all_that_is_near(spark, monkeypatch, long):
    """Dense balls, chains, and random values; with postings split and split again."""
    monkeypatch.setattr(simhash, "LONG", long)
    rnd = random.Random(4)
    values = {rnd.getrandbits(64) for _ in range(60)}
    center = rnd.getrandbits(64)
    for _ in range(120 if long > 4 else 40):
        values.add(center ^ (1 << rnd.randrange(10)) ^ (1 << rnd.randrange(24)))
    at = rnd.getrandbits(64)
    for _ in range(25):
        values.add(at)
        at ^= sum(1 << b for b in rnd.sample(range(64), 3))
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).view("i8")),) for v in values], "fp long")
    links = simhash.fingerprint_links(df).collect()
    u = lambda x: int(np.int64(x).view("u8"))
    assert all((u(r["a"]) ^ u(r["b"])).bit_count() <= 3 for r in links)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(u(r["a"]))] = find(u(r["b"]))
    want = groups(values)
    mine = [find(v) for v in values]
    assert len(set(zip(want, mine, strict=True))) == len(set(want)) == len(set(mine))


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def kept(texts, window):
    ws = [words(t) for t in texts]
    n = collections.Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((w, gone))
    return out


def test_passages(docs, none):
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in suffixes.repeated_passages(docs).collect())
    want = [(r[0] or 0, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for r, (w, g) in zip(rows(), kept([r[1] for r in rows()], 35), strict=True)]
    assert got == sorted(want)
    assert suffixes.repeated_passages(none).count() == 0 and suffixes.repeated_passages(none, clean=True).columns == none.columns


def whole_repeats(texts, window):
    """Longest runs of repeated windows that have all their occurrences in common, by text; and how often each window occurs."""
    places = collections.defaultdict(set)
    ws = [words(t) for t in texts]
    for i, w in enumerate(ws):
        for a in range(len(w) - window + 1):
            places[tuple(w[a : a + window])].add((i, a))
    out = []
    for w in ws:
        own = [places[tuple(w[a : a + window])] for a in range(len(w) - window + 1)]
        spans = []
        for a, p in enumerate(own):
            if len(p) < 2:
                continue
            if spans and spans[-1][1] == a + window - 2 and {(i, b + 1) for i, b in own[a - 1]} == p:
                spans[-1][1] += 1
            else:
                spans.append([a, a + window - 1])
        out.append(spans)
    return out, {k: len(v) for k, v in places.items()}


@pytest.mark.parametrize(
    ("window", "prefix", "blob", "heavy", "group"), [(5, 2, 60, 1000, 1 << 20), (5, 2, 60, 4, 50), (8, 3, 1 << 20, 1, 1 << 20), (4, 4, 10, 30, 100), (1, 1, 40, 1000, 100)]
)
def test_passages_of_few_words(spark, monkeypatch, window, prefix, blob, heavy, group):
    """Few distinct words, so that repeats overlap in every way; small blobs, so that they meet across tasks; prefixes of both lengths, many groups."""
    rnd = random.Random(6)
    texts = [prose(rnd, rnd.randrange(30), list("abc")) for _ in range(60)]
    long = prose(rnd, 40, [f"w{i}" for i in range(500)])
    texts += [f"{prose(rnd, 6, list('abc'))} {long} x{i}" for i in range(3)] + [long, long.split(" ", 20)[-1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffixes, "blobs", lambda d, f=suffixes.blobs: f(d, blob))
    want = kept(texts, window)
    spans, times = whole_repeats(texts, window)
    got = {r["doc_id"]: r for r in suffixes.repeated_passages(df, window, prefix, heavy=heavy, group=group).collect()}
    for i, (w, g) in enumerate(want):
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), sum(g))
        assert [[s["first"], s["last"]] for s in got[i]["spans"]] == spans[i]
        cover = [False] * len(w)
        for a, b in spans[i]:
            cover[a : b + 1] = [True] * (b + 1 - a)
            # a span repeats as a whole, as often as its first window
            inner = f" {' '.join(w[a : b + 1])} "
            assert sum(f" {' '.join(v)} ".startswith(inner, k) for v, _ in want for k in range(len(" ".join(v)) + 1)) == times[tuple(w[a : a + window])]
        assert cover == g
    clean = {r["doc_id"]: r["text"] for r in suffixes.repeated_passages(df, window, prefix, True, heavy, group).collect()}
    assert clean == {i: " ".join(x for x, y in zip(w, g, strict=True) if not y) if any(g) else texts[i] for i, (w, g) in enumerate(want)}


def test_order_of_suffixes():
    rnd = np.random.default_rng(5)
    for depth in (1, 2, 3, 7, 8, 35):
        numbers = rnd.integers(0, 3, 400)
        suffixes_of = [tuple(numbers[i : i + depth]) for i in range(len(numbers) - depth + 1)]
        place = {x: i for i, x in enumerate(sorted(set(suffixes_of)))}
        assert suffixes.ranks(numbers, depth).tolist() == [place[x] for x in suffixes_of]


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def expected(texts, items):
    windows = collections.defaultdict(set)
    for k, t in items:
        w = bench_words(t)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(k)
    out = []
    for t in texts:
        w = bench_words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if ks := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= ks
        ids = sorted(str(k) for k in found if k is not None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontamination(spark, docs, none, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
    rs = rows()
    items = [(1, rs[17][1]), (2, "One, two; THREE"), (3, None), (4, "!!!"), (10, " ".join(rs[12][1].split()[100:111])), (11, "same same"), (12, " ".join(["same"] * 12)), (None, "épsilon"), (10, " ".join(rs[12][1].split()[100:111]))]
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, p int")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect())
    want = sorted((r[0] or 0, *x) for r, x in zip(rs, expected([r[1] for r in rs], items), strict=True))
    assert got == want
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in clean.collect()) == sorted(w[0] for w in want if not w[5])
    if most:
        assert decontaminate.contamination(none, bench).count() == 0
        assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_every_shared_span_is_found(spark):
    """Planted spans of ten words and more, of few distinct words."""
    rnd = random.Random(8)
    items = [(k, prose(rnd, rnd.randrange(1, 30), list("abcd"))) for k in range(25)]
    texts = []
    for _ in range(60):
        t = prose(rnd, rnd.randrange(60), list("abcd")).split(" ")
        w = rnd.choice(items)[1].split(" ")
        t[len(t) // 2 : len(t) // 2] = w[: rnd.randrange(1, 14)]
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == dict(enumerate(expected(texts, items)))


def test_only_dataframe_functions(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    plan = decontaminate.contamination(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def similar_groups(sets):
    """Classes of sets at a similarity of 0.8 or more, by brute force."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def test_near_dedup_reaches_similarity(spark):
    """Texts with words changed until under 0.8, and chains of them; fingerprints differ by more than 3 bits."""
    import corpus_pipeline

    rnd = random.Random(31)
    texts = []
    for _ in range(25):
        w = prose(rnd, 120, [f"v{i}" for i in range(2000)]).split(" ")
        texts.append(" ".join(w))
        for _ in range(6):
            if rnd.random() < 0.5:
                w = w.copy()
            for _ in range(rnd.randrange(1, 4)):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
            texts.append(" ".join(w))
    hot = prose(rnd, 150, [f"h{i}" for i in range(2000)]).split(" ")
    for k in range(80):
        w = hot.copy()
        w[k] = f"other{k}"
        texts.append(" ".join(w))
    texts += ["", None, " ", "One two", "one  TWO", texts[3]]
    rnd.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words((t or "").lower()) for t in texts)]
    g = similar_groups(sets)
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    out = corpus_pipeline.near_dedup(spark, df, "")
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(g))
    assert len(set(g)) < len(set(groups([fingerprint(t) for t in texts])))


def test_rows_of_one_doc_id_in_different_components_stay(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "one text of its own here"), (1, "quite another text that is no copy"), (1, "one text of its own here"), (2, "quite another text that is no copy"), (None, "no id")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == [(0, "no id"), (1, "one text of its own here"), (1, "quite another text that is no copy")]


def bucket(spark, n, main=0):
    """One bucket of n members that share nothing else, each a component, and of `main` members of one component."""
    rows = [(0, 5, i, i, 0) for i in range(n)] + [(0, 5, 1000000 + i, -1, 1) for i in range(main)]
    return spark.createDataFrame(rows, "slot int, key long, node long, root long, main int")


@pytest.mark.parametrize(("held", "passing"), [(7, 6), (100, 100), (7, 100), (100, 6)])
def test_cells_let_all_meet_once(spark, monkeypatch, held, passing):
    monkeypatch.setattr(shingles, "HELD", held)
    monkeypatch.setattr(shingles, "PASSING", passing)
    cells = collections.defaultdict(lambda: ([], []))
    for r in shingles._cells(bucket(spark, 40, 25)).collect():
        cells[r["i"], r["j"]][r["side"]].append(r["node"])
    met = collections.Counter()
    for (i, j), (left, right) in cells.items():
        if i == j:
            met.update(tuple(sorted(x)) for x in itertools.combinations(left, 2))
        met.update((min(x, y), max(x, y)) for x in left for y in right)
    every = range(40)
    assert met == collections.Counter([*itertools.combinations(every, 2), *((x, 1000000 + y) for x in every for y in range(25))])
    assert max(len(left) for left, _ in cells.values()) < 3 * held


def test_work_of_a_bucket_grows_with_its_members(spark, monkeypatch):
    """Members that share one band and nothing else: they are parted by second bands, and hardly any is left to compare."""
    monkeypatch.setattr(shingles, "SPLIT", 50)
    left = []
    for n in (200, 400):
        rnd = random.Random(n)
        postings = [(0, 5, i) for i in range(n)] + [(s, rnd.randrange(1 << 40), i) for i in range(n) for s in range(1, 8)]
        # two near ones share three bands
        postings += [(s, 9, i) for s in (20, 21) for i in (0, 1)]
        out = shingles._parted(bucket(spark, n), spark.createDataFrame(postings, "slot int, key long, node long")).collect()
        assert {r["node"] for r in out} == {0, 1} and {r["slot"] for r in out} == {20, 21}
        left.append(len(out))
    assert left[1] <= 2 * left[0]
    small = shingles._parted(bucket(spark, 50), spark.createDataFrame([(0, 5, i) for i in range(50)], "slot int, key long, node long"))
    assert small.count() == 50


def test_settling_in_small_cells_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shingles, "HELD", 3)
    monkeypatch.setattr(shingles, "PASSING", 4)
    monkeypatch.setattr(shingles, "PIVOTS", 1)
    monkeypatch.setattr(shingles, "SAMPLE", 2)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(60):
        own = base[:]
        for _ in range(rnd.randrange(14)):
            own[rnd.randrange(400)] = f"x{k}y{rnd.randrange(50)}"
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(shingles.shingles(t).tolist()) for t in texts]
    want = similar_groups(sets)
    got = {r["doc_id"]: r["component_id"] for r in shingles.similar(df).collect()}
    assert len(set(got.values())) > 1
    assert {frozenset(k for k in got if got[k] == c) for c in got.values()} == {frozenset(i for i in range(60) if want[i] == c) for c in want}


def test_near_dedup_with_clashing_columns_and_repeated_ids(spark):
    import corpus_pipeline

    names = ["component_id", "shingle_root", "shingle_set", "shingle_bands", "shingle_sign", "shingle_salt", "salt", "root", "component", "place", "Component_", "node", "slot", "key", "odd name"]
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long, 5), (1, long + " end", 4), (1, long, 3), (1, other, 1), (2, long, 9), (3, other, 9), (None, long, 2), (4, None, 1), (5, "", 1)]
    df = spark.createDataFrame([(d, t, *([n] * len(names))) for d, t, n in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    for parts in (1, 4):
        out = corpus_pipeline.near_dedup(spark, df.repartition(parts, "odd name"), "")
        assert out.columns == df.columns
        # of the rows of one id and component the first by text, then by the other columns
        assert sorted(((r["doc_id"], r["text"], r["odd name"]) for r in out.collect()), key=str) == sorted([(1, long, 3), (1, other, 1), (None, long, 2), (4, None, 1)], key=str)
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0
    with pytest.raises(ValueError, match="component_id"):
        shingles.similar(df)


def test_tables_within_passing_are_deleted(spark):
    import os

    from quillpack.llm import common

    with common.passing(spark):
        a = common.materialise(spark.range(5), "a")
        b = common.materialise(a.where("id > 2"), "b", keep=True)
        gone = a.inputFiles()
    c = common.materialise(spark.range(2), "c")
    assert b.count() == 2 and c.count() == 2 and gone and not any(os.path.exists(f.removeprefix("file://")) for f in gone)
    with pytest.raises(ZeroDivisionError), common.passing(spark):
        gone = common.materialise(spark.range(5), "d").inputFiles()
        1 / 0  # noqa: B018
    assert not os.path.exists(gone[0].removeprefix("file://")) and not common._passing


def test_near_dedup_takes_the_byte_index(spark, monkeypatch):
    """What op4's index finds is joined, and verified, without any candidate of MinHash."""
    from pyspark.sql import functions as F

    from corpus_pipeline import near_dedup
    from quillpack.llm.simhash import folded

    fold = lambda t: folded(shingles.shingles(t).astype(">u8").view("u1").reshape(-1, 8))
    words = [f"w{i * 7919 % 1000}" for i in range(300)]
    first = " ".join(words)
    copies = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(300)]
    near = next(t for t in copies if 0 < (fold(t) ^ fold(first)).bit_count() <= 3)
    far = " ".join(f"v{i}" for i in range(300))
    docs = spark.createDataFrame([(1, first), (2, near), (3, far)], "doc_id long, text string")
    monkeypatch.setattr(shingles, "_likely", lambda pairs, members: pairs.limit(0))
    monkeypatch.setattr(shingles, "_postings", lambda members: members.select(F.lit(0).alias("slot"), F.lit(0).cast("long").alias("key"), "node").limit(0))
    assert sorted(r["doc_id"] for r in near_dedup(spark, docs, "").collect()) == [1, 3]
