"""SimHash near copies: a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Two that differ in at most 3 bits share at least 5 of them, so at least 3 in
one half: the index has a posting for every 3 positions of the same half and the bytes there (8 per distinct fingerprint), and a
pair to be found meets in one of them. Within a posting the shared positional bytes of each pair are tallied, pairs of
at least 5 are kept, and these are verified on their bits. A posting's pairs stay in the task; it yields links that join what is
linked, fewer than it has members.

Postings of more than LONG members are split without losing a pair: their members go into postings of 5 positions each (56; a
pair to be found shares all bytes of one of them, so what remains is 24 bits). If one of those is still longer than LONG, its
members are grouped by what they have in common outside every 3 of the 24 bits (2024 masks): members of such a group are all
linked, and a group yields a star. No step costs more than its members times a constant.

Fingerprints are distinct before they are indexed: exact and near copies with equal fingerprints are one posting entry,
whatever their number.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, materialise, slices
from .components import components

BITS, SHARED = 3, 5
#: Members that a posting's pairs are tallied for in one go.
LONG = 2048
HALVES = [c for half in (range(4), range(4, 8)) for c in itertools.combinations(half, 3)]
FIVES = list(itertools.combinations(range(8), SHARED))


def fingerprint(text: str, words: int = 3) -> int:
    """Bit b is set if it is in over half the shingles' XXH64 (seed 42); repeats count. No word: 0."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = xxhash.xxh64_digest
    return folded(np.frombuffer(b"".join([h(g, 42) for g in grams]), np.uint8).reshape(-1, 8))


def folded(rows: np.ndarray) -> int:
    """Bit b is set if it is in over half of some hashes, given as rows of eight bytes, the highest first; 0 for none."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(rows), 1 << 14):
        ones += np.unpackbits(rows[a : a + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keys = column(batch, "doc_id")
            for a, texts in slices(batch):
                yield {"doc_id": keys.slice(a, len(texts)), "fp": np.array([fingerprint(t, words) for t in texts], "u8").view("i8")}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links between distinct unsigned values that join all within BITS bits of each other, directly or over others."""
    n = len(values)
    bytes_of = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(n - 1):
        tally = (bytes_of[i + 1 :] == bytes_of[i]).sum(1)
        near = np.flatnonzero(tally >= SHARED)
        if len(near):
            near = near[np.bitwise_count(values[i + 1 :][near] ^ values[i]) <= BITS]
        for j in near.tolist():
            a, b = find(i), find(i + 1 + j)
            if a != b:
                root[b] = a
                out.append((i, i + 1 + j))
    return out


def _postings(f: DataFrame, positions: list[tuple[int, ...]]) -> DataFrame:
    """slot, key, fp for each set of positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            v = column(batch, "fp").to_numpy().view("u8")
            for k, which in enumerate(positions):
                mask = np.uint64(sum(0xFF << 8 * (7 - p) for p in which))
                yield {"slot": np.full(len(v), k, "i4"), "key": (v & mask).view("i8"), "fp": v.view("i8")}

    return map_arrow(f.select("fp"), run, "slot int, key long, fp long")


def _links(postings: DataFrame) -> DataFrame:
    """Links of all postings, each of which is at most LONG members long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[np.ndarray] = [np.zeros((0, 3), "i8")]

        def joined(rows: np.ndarray) -> dict:
            cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(rows)]
            a: list[int] = []
            b: list[int] = []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                values = np.unique(rows[s:e, 2])
                for i, j in forest(values.view("u8")):
                    a.append(int(values[i]))
                    b.append(int(values[j]))
            return {"a": a, "b": b}

        for batch in batches:
            rows = np.column_stack([column(batch, c).to_numpy().astype("i8") for c in ("slot", "key", "fp")])
            rows = np.concatenate([*held, rows])
            last = int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1)).max(initial=-1)) + 1 if len(rows) else 0
            if last:
                yield joined(rows[:last])
            held = [rows[last:]]
        if len(held[0]):
            yield joined(held[0])

    return map_arrow(postings.repartition("slot", "key").sortWithinPartitions("slot", "key"), run, "a long, b long")


def _split(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of at most LONG members, and the members of longer ones. Counts are partial sums, and few keys are long."""
    sizes = postings.groupBy("slot", "key").count().where(F.col("count") > LONG).select("slot", "key")
    sizes = materialise(sizes, "long")
    if sizes.isEmpty():
        return postings, postings.limit(0)
    return postings.join(sizes, ["slot", "key"], "left_anti"), postings.join(sizes, ["slot", "key"], "left_semi")


def _stars(postings: DataFrame) -> DataFrame:
    """Links within long postings of 5 positions: a star for every 3 of the other 24 bits and the rest's value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            v, slots = column(batch, "fp").to_numpy().view("u8"), column(batch, "slot").to_numpy()
            for slot in np.unique(slots).tolist():
                own = v[slots == slot]
                free = [8 * (7 - p) + b for p in range(8) if p not in FIVES[slot] for b in range(8)]
                for k, three in enumerate(itertools.combinations(free, BITS)):
                    mask = np.uint64(~sum(1 << b for b in three) & 0xFFFFFFFFFFFFFFFF)
                    yield {"slot": np.full(len(own), slot * 4096 + k, "i4"), "key": (own & mask).view("i8"), "fp": own.view("i8")}

    members = map_arrow(postings.select("slot", "fp"), run, "slot int, key long, fp long")
    least = members.groupBy("slot", "key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return members.join(least, ["slot", "key"]).where("fp != a").select("a", F.col("fp").alias("b"))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links a, b between the fingerprints of a column fp of distinct values, enough to join all that are within BITS bits."""
    short, long = _split(materialise(_postings(distinct, HALVES), "postings"))
    links = _links(short)
    if not long.isEmpty():
        short, long = _split(materialise(_postings(long.select("fp").distinct(), FIVES), "postings"))
        links = links.union(_links(short))
        if not long.isEmpty():
            links = links.union(_stars(long))
    return links


def near_copies(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row: the least doc_id of its component.

    Fingerprints of 3 or fewer differing bits are linked. A null text is empty, and all texts without a word have
    fingerprint 0; repeated rows stay, in one component; a null doc_id has a component but never names one unless all its members are
    null; an empty table gives no rows; other columns are left out.
    """
    f = materialise(fingerprints(docs, words), "fingerprints")
    distinct = f.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(distinct.select("fp")))
    group = materialise(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "groups")
    names = group.groupBy("root").agg(F.min("least").alias("component_id"))
    named = group.join(names, "root").select("fp", "component_id")
    # many copies have one fingerprint: the hot side is split over tasks by a salt that the other side repeats
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = f.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["fp", "salt"], "left")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Tasks that the documents of one fingerprint are dealt to.
SALTS = 16
