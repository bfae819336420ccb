"""A log-bilinear language model, trained by noise-contrastive estimation in numpy, that scores whole texts.

The model predicts a class from the two classes before it: score(t | a, b) = (c1 * R[a] + c2 * R[b]) . Q[t] + bias[t]. Classes are
the end of a text, the OWN most frequent tokens, and SUFFIXES classes that all other tokens fall into by a hash of their
last three bytes; such a token's probability within its class is its smoothed share of it. Scores are exactly normalised: exp of the
score is a product of one factor of (a, t) and one of (b, t), so the sums over t of all context pairs are one matrix
product, and a token's log-probability is three look-ups.

Training reads every training text, in ROUNDS rounds. A text's shard, its round and its place there are given by hashes of the row, and the
number of shards by the number of tokens; a task passes over a shard by stochastic steps from the round's start, and the
shards' parameters (with their step sizes) are averaged by tokens, in order, to be the next round's start. So the model, and
each score, depends on the rows alone, not on their files, order or partitions.

Counts cover all training tokens. They are kept by buckets of tokens, as compressed lists. The HEAD most frequent tokens
travel with the code; of the others, each blob of some MB of texts asks every bucket once for the distinct ones it has.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, materialise, parts_for, scratch, text_slices

#: The end of a text; no token holds white space.
END = b"\n"
HEAD, OWN, SUFFIXES = 100_000, 767, 256
WIDTH, NOISE, BATCH, RATE, ROUNDS = 24, 48, 2048, 0.15, 4
#: Tokens of a shard, and shards at most (a shard is passed over, not held).
SHARD, MOST_SHARDS = 4_000_000, 20_000
#: Tokens a task counts before it hands its counts on; bytes of texts at a time when counting and when scoring; bytes of input to a bucket.
HELD, COUNTED, BLOB, BUCKET = 400_000, 8 << 20, 2 << 20, 32 << 20


def lexed(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, the number of every token of all texts in a row, tokens of each text).

    A-Z in lower case, split at ASCII white space, and an end behind each text, whose number is the one behind the last distinct token.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    at = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    where, words, sizes = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()), np.diff(at)
    none = pc.index(words, b"").as_py()
    if none >= 0:  # white space at an end
        full = where != none
        sizes = np.add.reduceat(full, at[:-1])
        where = where[full] - (where[full] > none)
        words = pa.concat_arrays([words.slice(0, none), words.slice(none + 1)])
    return words, np.insert(where, np.cumsum(sizes), len(words)), sizes + 1


def compressed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def expanded(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def packed(words: list[bytes], numbers: list[int] | np.ndarray) -> tuple[bytes, bytes]:
    press = zstandard.ZstdCompressor(level=3).compress
    return press(b" ".join(words)), press(np.asarray(numbers, "i8").tobytes())


def unpacked_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw.split(b" ") if raw else []


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "i8")


def parted(words: list[bytes], buckets: int) -> dict[int, list[bytes]]:
    """Ordered words by bucket, still in order."""
    out: dict[int, list[bytes]] = {}
    for w in words:
        out.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return out


COUNTS = "bucket int, words binary, counts binary, total long, n long"


def token_counts(train: DataFrame, buckets: int) -> DataFrame:
    """For each bucket its tokens (ends included) in order, how often each occurs in train's texts, the sum, and how many they are.

    Tasks hand on partial counts, a compressed list a bucket; a task holds the distinct tokens of a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: Counter[bytes] = Counter()

        def made() -> Iterator[dict]:
            for k, words in parted(sorted(held), buckets).items():
                w, c = packed(words, [held[x] for x in words])
                yield {"bucket": [k], "words": [w], "counts": [c], "total": [0], "n": [0]}

        for batch in batches:
            for _, texts in text_slices(batch, limit=COUNTED):
                words, where, _ = lexed(texts)
                get = held.get
                for w, c in zip([*words.to_pylist(), END], np.bincount(where, minlength=len(words) + 1).tolist(), strict=True):
                    held[w] = get(w, 0) + c
                if len(held) > HELD:
                    yield from made()
                    held.clear()
        yield from made()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, held = None, {}

        def made() -> dict:
            words = sorted(held)
            w, c = packed(words, [held[x] for x in words])
            return {"bucket": [now], "words": [w], "counts": [c], "total": [sum(held.values())], "n": [len(held)]}

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now:
                    if held:
                        yield made()
                    now, held = row["bucket"], {}
                get = held.get
                for w, c in zip(unpacked_words(row["words"]), unpacked(row["counts"]).tolist(), strict=True):
                    held[w] = get(w, 0) + c
        if held:
            yield made()

    parts = map_arrow(train.select("text"), run, COUNTS)
    return map_arrow(parts.repartition("bucket").sortWithinPartitions("bucket"), merge, COUNTS)


def suffix_classes(words: pa.Array) -> np.ndarray:
    """The suffix class of each token."""
    ends = pc.binary_slice(words, -3, None).dictionary_encode()
    return np.array([zlib.crc32(x) % SUFFIXES for x in ends.dictionary.to_pylist()], "i8")[ends.indices.to_numpy()]


class Head(NamedTuple):
    """The most frequent tokens without the end, from the most frequent one, and their counts.

    Class 0 is the end, the first `own` tokens have the classes 1.., and the suffix classes are behind them; of these, the tokens that have no class of
    their own are counted in held (how often they occur) and kinds (how many there are).
    """

    words: list[bytes]
    counts: np.ndarray
    ends: int
    own: int
    held: np.ndarray
    kinds: np.ndarray
    total: int
    distinct: int

    @property
    def classes(self) -> np.ndarray:
        """The class of each word of the head."""
        return np.r_[np.arange(self.own), self.own + suffix_classes(pa.array(self.words[self.own :], pa.large_binary()))] + 1

    def by_class(self) -> np.ndarray:
        return np.r_[self.ends, self.counts[: self.own], self.held].astype("f8")

    def mass(self) -> np.ndarray:
        """Smoothed count of each suffix class: each token seen, and one unseen."""
        return self.held + 0.1 * (self.kinds + 1)


def size_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1)) * 64).astype("i4")


def head(counts: DataFrame, most: int = HEAD, own: int = OWN) -> Head:
    total = counts.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("v")).first()

    # how many tokens have a count of each size (64 sizes to a doubling): what comes back is bounded by the number of sizes
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                k, n = np.unique(size_of(unpacked(row["counts"])), return_counts=True)
                yield {"k": k, "n": n}

    # of the size for which there is no more room, the tokens with the least hashes
    least, part, kept = 0, 1.0, 0
    for k, n in map(tuple, map_arrow(counts, sizes, "k int, n long").groupBy("k").agg(F.sum("n")).orderBy(F.desc("k")).collect()):
        least, part = k, min(1.0, (most - kept) / n)
        kept += n
        if kept >= most:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                c, words = unpacked(row["counts"]), unpacked_words(row["words"])
                k = size_of(c)
                at = [i for i in np.flatnonzero(k >= least).tolist() if k[i] > least or part == 1 or words[i] == END or zlib.crc32(b"head" + words[i]) < part * 2**32]
                yield {"w": [words[i] for i in at], "c": c[at]}

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, kinds = np.zeros(SUFFIXES, "i8"), np.zeros(SUFFIXES, "i8")
        for batch in batches:
            for row in batch.to_pylist():
                k = suffix_classes(pa.array(unpacked_words(row["words"]), pa.large_binary()))
                held += np.bincount(k, unpacked(row["counts"]), SUFFIXES).astype("i8")
                kinds += np.bincount(k, minlength=SUFFIXES)
        yield {"k": np.arange(SUFFIXES), "held": held, "kinds": kinds}

    # about `most` rows in all
    top = sorted(((bytes(r["w"]), r["c"]) for r in map_arrow(counts, run, "w binary, c long").collect()), key=lambda x: (-x[1], x[0]))
    ends = next((c for w, c in top if w == END), 0)
    top = [x for x in top if x[0] != END]
    words, n = [w for w, _ in top], np.array([c for _, c in top], "f8")
    held, kinds = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for k, a, b in map(tuple, map_arrow(counts, suffixes, "k int, held long, kinds long").groupBy("k").agg(F.sum("held"), F.sum("kinds")).collect()):
        held[k], kinds[k] = a, b
    apart = [*words[:own], *([END] if ends else [])]
    k = suffix_classes(pa.array(apart, pa.large_binary()))
    held -= np.bincount(k, [*n[:own], *([ends] if ends else [])], SUFFIXES)
    kinds -= np.bincount(k, minlength=SUFFIXES)
    return Head(words, n, ends, len(words[:own]), held, kinds, total["n"], total["v"])


class Model(NamedTuple):
    r: np.ndarray
    q: np.ndarray
    bias: np.ndarray
    c: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self])

    @staticmethod
    def of(flat: np.ndarray, n: int, width: int) -> Model:
        at = np.cumsum([n * width, n * width, n, 2 * width])
        a, b, c, d = np.split(flat, at[:-1])
        return Model(a.reshape(n, width), b.reshape(n, width), c, d.reshape(2, width))


def start(by_class: np.ndarray, width: int = WIDTH, seed: int = 7) -> tuple[Model, Model]:
    """The parameters to begin with, and the sums of squared gradients."""
    rng, n = np.random.default_rng(seed), len(by_class)
    share = (by_class + 0.1) / (by_class + 0.1).sum()
    m = Model(rng.normal(0, 0.3, (n, width)), rng.normal(0, 0.1, (n, width)), np.log(share), np.stack([np.ones(width), np.full(width, 0.5)]))
    return m, Model(*(np.full_like(x, 1e-2) for x in m))


def train(begin: tuple[Model, Model], by_class: np.ndarray, stream: Iterator[np.ndarray], seed: int) -> tuple[Model, Model, int]:
    """Noise-contrastive steps over arrays (target, last, last but one); what is given is copied. Returns also the number of tokens."""
    m, total = (Model(*(x.copy() for x in y)) for y in begin)
    n, width = m.r.shape
    share = (by_class + 0.1) / (by_class + 0.1).sum()
    rng, cum = np.random.default_rng(seed), np.cumsum(share)
    log_noise = np.log(NOISE * share)
    seen = 0

    def rows(index: np.ndarray, values: np.ndarray) -> np.ndarray:
        order = np.argsort(index, kind="stable")
        sorted_ = index[order]
        first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        out = np.zeros((n, values.shape[1]))
        out[sorted_[first]] = np.add.reduceat(values[order], first)
        return out

    for part in stream:
        t, a, b = part
        seen += len(t)
        noise = np.minimum(np.searchsorted(cum, rng.random(NOISE)), n - 1)
        ra, rb = m.r[a], m.r[b]
        ctx = ra * m.c[0] + rb * m.c[1]
        qt, qn = m.q[t], m.q[noise]
        up = 1 / (1 + np.exp(np.clip((ctx * qt).sum(1) + m.bias[t] - log_noise[t], -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(ctx @ qn.T + m.bias[noise] - log_noise[noise], -30, 30)))
        d_ctx = up[:, None] * qt + down @ qn
        d_q = rows(t, np.column_stack([up[:, None] * ctx, up]))
        np.add.at(d_q, noise, np.column_stack([down.T @ ctx, down.sum(0)]))
        d_r = rows(np.r_[a, b], np.concatenate([d_ctx * m.c[0], d_ctx * m.c[1]]))
        d_c = np.stack([(d_ctx * ra).sum(0), (d_ctx * rb).sum(0)])
        for x, g, s in zip(m, (d_r, d_q[:, :-1], d_q[:, -1], d_c), total, strict=True):
            g = g / len(t) * 64
            s += g * g
            x += RATE * g / np.sqrt(s)
    return m, total, seen


def contexts(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, class before, class before that) of every token; in front of a text stand ends. ends: where texts end."""
    last, before = np.zeros_like(ids), np.zeros_like(ids)
    last[1:] = ids[:-1]
    before[2:] = ids[:-2]
    begin = np.r_[0, ends[:-1]]
    before[begin] = 0
    second = begin + 1
    before[second[second < len(ids)]] = 0
    return ids, last, before


def batches_of(texts: Iterator[bytes]) -> Iterator[np.ndarray]:
    """Arrays of BATCH contexts (fewer at the end) of texts' classes."""
    held, size = [], 0
    for t in texts:
        ids = np.frombuffer(t, "u2").astype("i8")
        held.append(np.stack(contexts(ids, np.array([len(ids)]))))
        size += len(ids)
        if size >= 16 * BATCH:
            whole = np.concatenate(held, 1)
            for a in range(0, size - BATCH + 1, BATCH):
                yield whole[:, a : a + BATCH]
            held, size = [whole[:, size - size % BATCH :]], size % BATCH
    whole = np.concatenate(held, 1) if size else np.zeros((3, 0), "i8")
    for a in range(0, size, BATCH):
        yield whole[:, a : a + BATCH]


LEARNED = "part int, shard int, key long, ids binary"


def learn(scored: DataFrame, h: Head, width: int = WIDTH, shard: int = SHARD) -> Model:
    """The model of all rows of `scored` that aren't held out. What comes to the driver is the square root of the number of shards, in models."""
    by_class = h.by_class()
    spark, shards = scored.sparkSession, min(MOST_SHARDS, max(1, -(-h.total // shard)))
    groups = int(np.ceil(np.sqrt(shards)))
    path = scratch(spark, "learned")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, ends = expanded(row["ids"], "u2"), np.cumsum(row["n_tokens"])
                at = [i for i, x in enumerate(row["held_out"]) if x is False]
                key = np.array(row["key"], "i8")[at].view("u8")
                yield {"part": (key >> np.uint64(48)) % np.uint64(ROUNDS), "shard": key % np.uint64(shards), "key": key.view("i8"), "ids": [ids[ends[i] - row["n_tokens"][i] : ends[i]].tobytes() for i in at]}

    map_arrow(scored.select("ids", "n_tokens", "held_out", "key"), deal, LEARNED).write.partitionBy("part").parquet(path)
    texts = spark.read.schema(LEARNED).parquet(path)
    state = start(by_class, width)
    ddl = "g int, shard int, n double, m binary"

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                s = sums.setdefault(row["g"], [0.0, 0.0])
                s[0] += row["n"]
                s[1] = s[1] + row["n"] * np.frombuffer(row["m"], "f8")
        for g, (n, x) in sums.items():
            yield {"g": [g], "shard": [0], "n": [n], "m": [(x / n).tobytes()]}

    for turn in range(ROUNDS):
        held = spark.sparkContext.broadcast((by_class, state))

        def run(batches: Iterator[pa.RecordBatch], held=held, turn=turn) -> Iterator[dict]:
            rows = ((k, t) for batch in batches for k, t in zip(column(batch, "shard").to_pylist(), column(batch, "ids").to_pylist(), strict=True))
            ahead = next(rows, None)
            while ahead is not None:
                now = ahead[0]

                def own(now=now) -> Iterator[bytes]:
                    nonlocal ahead
                    while ahead is not None and ahead[0] == now:
                        yield ahead[1]
                        ahead = next(rows, None)

                m, total, seen = train(held.value[1], held.value[0], batches_of(own()), now * ROUNDS + turn)
                yield {"g": [now % groups], "shard": [now], "n": [float(seen)], "m": [np.concatenate([m.flat(), total.flat()]).tobytes()]}

        own = texts.where(F.col("part") == turn).select("shard", "key", "ids").repartition(shards, "shard").sortWithinPartitions("shard", "key", "ids")
        got = map_arrow(map_arrow(own, run, ddl).repartition("g").sortWithinPartitions("g", "shard"), mean, ddl).collect()
        held.unpersist()
        if got:
            got.sort(key=lambda r: r["g"])
            flat = sum(r["n"] * np.frombuffer(bytes(r["m"]), "f8") for r in got) / sum(r["n"] for r in got)
            state = tuple(Model.of(x, len(by_class), width) for x in np.split(flat, 2))
    return state[0]


class Tables:
    """Normalised log-probabilities: a[last, t] + b[before, t] - z[last, before]."""

    def __init__(self, m: Model):
        a, b = (m.r * m.c[0]) @ m.q.T + m.bias, (m.r * m.c[1]) @ m.q.T
        top_a, top_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        z = np.log(np.exp(a - top_a) @ np.exp(b - top_b).T) + top_a + top_b.T
        self.a, self.b, self.z = a.astype("f4"), b.astype("f4"), z.astype("f4")

    def log10(self, t: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return (self.a[last, t].astype("f8") + self.b[before, t] - self.z[last, before]) / np.log(10)


_tables: dict[int, Tables] = {}
#: A blob's texts: of each, what the head tells of it, and where its other tokens begin in `tail`, indices into `words`; ids: classes of all tokens.
SCORED = "blob long, doc_id array<long>, held_out array<boolean>, key array<long>, n_tokens array<long>, ids binary, n_head array<long>, base array<double>, inner array<double>, ends array<long>, tail binary, words binary"
PRICED = SCORED.replace("key array<long>, ", "").replace("ids binary, ", "")
ASKED = "bucket int, asks int, blob long, words binary, counts binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def looked_up(scored: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """blob, found: for each bucket the counts of the blob's words there, in order."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                for k, words in parted(unpacked_words(row["words"]), buckets).items():
                    yield {"bucket": [k], "asks": [1], "blob": [row["blob"]], "words": [packed(words, [])[0]], "counts": [None]}

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now:
                    now, held = row["bucket"], {}
                if not row["asks"]:
                    held = dict(zip(unpacked_words(row["words"]), unpacked(row["counts"]).tolist(), strict=True))
                else:
                    yield {"blob": [row["blob"]], "bucket": [now], "counts": [packed([], [held.get(w, 0) for w in unpacked_words(row["words"])])[1]]}

    known = counts.select("bucket", F.lit(0).alias("asks"), F.lit(None).cast("long").alias("blob"), "words", "counts")
    asked = map_arrow(scored.select("blob", "words"), ask, ASKED).union(known)
    got = map_arrow(asked.repartition("bucket").sortWithinPartitions("bucket", "asks"), answer, "blob long, bucket int, counts binary")
    return got.groupBy("blob").agg(F.collect_list(F.struct("bucket", "counts")).alias("found"))


def text_scores(docs: DataFrame, held_out: str, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; held_out: a boolean expression over docs.

    Rows for which it is true, or null, are scored but not learned from. A null text is empty (one end); repeated rows
    are counted and scored each; without training rows every token is unseen; other columns are left out.
    """
    rows = docs.select("doc_id", "text", F.expr(held_out).alias("held"), F.xxhash64("doc_id", "text").alias("key"))
    learning = rows.where("not held")
    buckets = parts_for(docs, BUCKET)
    counts = materialise(token_counts(learning.select("text"), buckets), "counts")
    h = head(counts)
    held = docs.sparkSession.sparkContext.broadcast(h)
    total, scale = int(h.total), float(np.log10(h.total + 0.1 * (h.distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        h = held.value
        known, classes = pa.array(h.words, pa.large_binary()), h.classes
        log_c, log_mass, log_end = np.log10(h.counts + 0.1), np.log10(h.mass()), float(np.log10(h.ends + 0.1))
        blob = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, texts in text_slices(batch, limit=BLOB):
                words, where, n = lexed(texts)
                place = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()
                inside = place >= 0
                # of each distinct token, and of the end behind them: class, logarithm of its smoothed count, and of its share of its class
                kind = np.zeros(len(words) + 1, "i8")
                kind[:-1][inside] = classes[place[inside]]
                kind[:-1][~inside] = 1 + h.own + suffix_classes(words)[~inside]
                own, share = np.zeros(len(kind)), np.zeros(len(kind))
                own[:-1][inside], own[-1] = log_c[place[inside]], log_end
                far = kind > h.own
                share[far] = own[far] - log_mass[kind[far] - 1 - h.own]
                seen = np.r_[inside, h.ends > 0]
                tail = np.full(len(kind), -1)
                tail[:-1][~inside] = np.arange(int((~inside).sum()))
                owner, ends = np.repeat(np.arange(len(texts)), n), np.cumsum(n)
                sums = lambda x, owner=owner, k=len(texts): np.bincount(owner, x, k)
                at = np.flatnonzero(tail[where] >= 0)
                part = lambda c, a=a, k=len(texts), batch=batch: column(batch, c).slice(a, k).to_pylist()
                yield {
                    "blob": [blob], "doc_id": [part("doc_id")], "held_out": [part("held")], "key": [part("key")], "n_tokens": [n.tolist()], "ids": [compressed(kind[where].astype("u2"))],
                    "n_head": [sums(seen[where]).astype("i8").tolist()], "base": [sums(own[where]).tolist()], "inner": [sums(share[where]).tolist()],
                    "ends": [np.searchsorted(at, ends).tolist()], "tail": [compressed(tail[where[at]].astype("u4"))], "words": [packed(words.filter(pa.array(~inside)).to_pylist(), [])[0]],
                }
                blob += 1

    scored = materialise(map_arrow(rows, run, SCORED), "scored")
    model = docs.sparkSession.sparkContext.broadcast(learn(scored, h, shard=shard))

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        if id(model.value) not in _tables:
            _tables.clear()
            _tables[id(model.value)] = Tables(model.value)
        tables = _tables[id(model.value)]
        for batch in batches:
            for i in range(len(batch)):
                n = np.array(column(batch, "n_tokens")[i].as_py())
                p = tables.log10(*contexts(expanded(column(batch, "ids")[i].as_py(), "u2").astype("i8"), np.cumsum(n)))
                inner = np.array(column(batch, "inner")[i].as_py()) + np.bincount(np.repeat(np.arange(len(n)), n), p, len(n))
                yield {c: column(batch, c).slice(i, 1) for c in batch.schema.names} | {"inner": [inner.tolist()]}

    # the classes stay where they are: what is merged has no part that grows with each text but its rare tokens
    priced = map_arrow(scored.drop("key"), price, PRICED)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                found = {x["bucket"]: iter(unpacked(x["counts"]).tolist()) for x in row["found"] or []}
                c = np.array([next(found[zlib.crc32(w) % buckets]) for w in unpacked_words(row["words"])], "f8")
                n, k = np.array(row["n_tokens"]), len(row["doc_id"])
                tail, more, known = expanded(row["tail"], "u4"), np.zeros(k), np.array(row["n_head"])
                if len(tail):
                    owner = np.repeat(np.arange(k), np.diff(np.r_[0, row["ends"]]))
                    more = np.bincount(owner, np.log10(c + 0.1)[tail], k)
                    known = known + np.bincount(owner, (c > 0)[tail], k).astype("i8")
                yield {
                    "doc_id": row["doc_id"], "held_out": [h is not False for h in row["held_out"]], "n_tokens": row["n_tokens"], "n_known": known, "train_tokens": [total] * k,
                    "base_score": np.array(row["base"]) + more - n * scale, "score": np.array(row["inner"]) + more,
                }

    # merged at every size: what is looked up grows with the input, so it is never broadcast
    return map_arrow(priced.hint("merge").join(looked_up(scored, counts, buckets), "blob", "left"), finish, RESULT)


def forget() -> None:
    _tables.clear()
