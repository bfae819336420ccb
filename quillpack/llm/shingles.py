"""Near copies by similarity: candidates of the byte-position SimHash index and of MinHash, verified on whole shingle sets.

Two texts are near if the Jaccard similarity of their sets of five-word shingles (words lower-cased in ASCII and parted by ASCII
white space, fewer words than five being one shingle) is 0.8 or more. Shingles are compared as 64-bit hashes. Texts with
equal sets are one member, whatever their number.

A set has a SimHash fingerprint, and the inverted index of op4 (simhash.py) gives the fingerprints within three bits; sets of one fingerprint, and the least
ones of two that are linked, are candidates. Most pairs near 0.8 differ in more bits than the index promises to find, so MinHash gives the rest.

A set has HASHES least hashes, in BANDS bands of ROWS; a pair at 0.8 shares no band with a probability of (1 - 0.8 ** 4) ** 32,
5e-8. Only pairs whose signatures agree in AGREE of HASHES places (a pair at 0.8 fails that with a probability of about 1e-6) are verified. First,
every member of a bucket is tried against the bucket's least one, then, where the bucket's members are still in more than one component, against
a few pivots, each in the middle of what the pivots before it leave of a bounded sample: as many pairs as members, times a constant. What is left
apart then is settled within its bucket, where pairs stay in the task: the members outside of the bucket's largest component are held, the others pass by.

No bucket is settled in one task whatever its size. One with more than SPLIT members to hold is parted by a second band first: its members meet in
pairs of bands (a pair at 0.8 shares fewer than two bands with a probability of 1e-6). Of any bucket, chunks of about HELD members are held, and chunks of
about HELD or PASSING pass by; each such cell is a key of its own, so a task holds HELD sets at most at a time, and cells run beside each other.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, materialise, passing, slices
from .components import components
from .simhash import fingerprint_links, folded

WORDS = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
AGREE = 80
#: Pivots of a bucket, and the agreement at which a member counts as near one when the next is chosen.
PIVOTS, CLOSE = 4, 102
#: Members of a bucket that its pivots are chosen from: those of least hashes.
SAMPLE = 512
#: Members that a cell holds, and that pass by it, about; and members to hold beyond which a bucket is parted by a second band.
HELD, PASSING, SPLIT = 500, 20_000, 2_000
_DRAWS = np.random.default_rng(42).integers(0, 1 << 63, (2, HASHES), dtype="u8")
FLIPS, FACTORS = _DRAWS[0] << np.uint64(1), _DRAWS[1] << np.uint64(1) | np.uint64(1)
SET, BAND, SIGN, ROW, PRINT = "shingle_set", "shingle_bands", "shingle_sign", "shingle_row", "shingle_print"


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, "u8")
    grams = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(g, 42) for g in grams], "u8"))


def signature(own: np.ndarray) -> np.ndarray:
    """The least value of each hash."""
    out = np.full(HASHES, np.iinfo("u8").max, "u8")
    for a in range(0, len(own), 256):
        np.minimum(out, ((own[a : a + 256, None] ^ FLIPS) * FACTORS).min(0), out=out)
    return out


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two sorted sets is 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def signed(docs: DataFrame) -> DataFrame:
    """docs with the hash of each text's set, its bands, a byte of each least hash, and its fingerprint; no shuffle."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for a, texts in slices(batch):
                sets = [shingles(t) for t in texts]
                signs = [signature(s) for s in sets]
                own = {c: column(batch, c).slice(a, len(texts)) for c in names}
                yield own | {
                    SET: np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], "u8").view("i8"),
                    BAND: [b"".join(xxhash.xxh64_digest(x.tobytes()) for x in s.reshape(BANDS, ROWS)) for s in signs],
                    SIGN: [s.astype("u1").tobytes() for s in signs],
                    PRINT: np.array([folded(s.astype(">u8").view("u1").reshape(-1, 8)) for s in sets], "u8").view("i8"),
                }

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, run, f"{ddl}, {SET} long, {BAND} binary, {SIGN} binary, {PRINT} long")


def _postings(members: DataFrame) -> DataFrame:
    """slot, key, node for each band of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            nodes = column(batch, "node").to_numpy()
            keys = np.frombuffer(b"".join(column(batch, BAND).to_pylist()), "i8").reshape(-1, BANDS)
            yield {"slot": np.tile(np.arange(BANDS, dtype="i4"), len(nodes)), "key": keys.ravel(), "node": np.repeat(nodes, BANDS)}

    return map_arrow(members.select("node", BAND), run, "slot int, key long, node long")


def _indexed(members: DataFrame) -> DataFrame:
    """Pairs a, b of the sets that the byte-position index finds: of one fingerprint, and the least ones of linked fingerprints."""
    least = materialise(members.groupBy(PRINT).agg(F.min("node").alias("least")), "prints")
    same = members.select("node", PRINT).join(least, PRINT).where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    sides = [least.select(F.col(PRINT).alias(x), F.col("least").alias(y)) for x, y in (("a", "x"), ("b", "y"))]
    linked = fingerprint_links(least.select(F.col(PRINT).alias("fp"))).join(sides[0], "a").join(sides[1], "b")
    return same.union(linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _likely(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs a, b whose signatures agree in AGREE places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(column(batch, c).to_pylist()), "u1").reshape(-1, HASHES) for c in ("x", "y"))
            keep = pa.array((x == y).sum(1) >= AGREE)
            yield {c: column(batch, c).filter(keep) for c in ("a", "b")}

    signs = members.select("node", SIGN)
    both = pairs.join(signs.toDF("a", "x"), "a").join(signs.toDF("b", "y"), "b")
    return map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long")


def _sets(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node, own: the shingles of the sets in the column node of nodes, once each. Of equal sets one row's text is read, where it lies."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            nodes = column(batch, SET)
            for a, texts in slices(batch):
                yield {"node": nodes.slice(a, len(texts)), "own": [shingles(t).tobytes() for t in texts]}

    wanted = nodes.select(F.col("node").alias(SET)).distinct()
    chosen = materialise(rows.select(SET, ROW).join(wanted, SET, "left_semi").groupBy(SET).agg(F.min(ROW).alias(ROW)).select(ROW), "chosen")
    return materialise(map_arrow(rows.select(ROW, SET, "text").join(chosen, ROW, "left_semi").select(SET, "text"), cut, "node long, own binary"), "sets")


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs a, b whose sets are near. A set a goes once to each of its chunks of about PASSING sets b, which pass by."""
    keys = ("a", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = np.zeros(0, "u8")
        for new, part in _groups(batches, keys):
            own, nodes = column(part, "own"), column(part, "node")
            if new:
                held = np.frombuffer(own[0].as_py(), "u8")
            keep = [nodes[i].as_py() for i in range(int(new), len(nodes)) if near(held, np.frombuffer(own[i].as_py(), "u8"))]
            if keep:
                yield {"a": [column(part, "a")[0].as_py()] * len(keep), "b": keep}

    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), rows)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / PASSING).cast("int").alias("n"))
    cut = materialise(pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("chunk"), "b"), "cut")
    left = cut.select(*keys).distinct().withColumn("node", F.col("a")).withColumn("side", F.lit(0))
    both = left.unionByName(cut.select(*keys, F.col("b").alias("node")).withColumn("side", F.lit(1))).join(sets, "node")
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "side", "node").select(*keys, "node", "own")
    return materialise(map_arrow(dealt, run, "a long, b long"), "near")


def _apart(rooted: DataFrame) -> DataFrame:
    """slot, key, node, root, main (1: of the bucket's largest component) of the members of buckets with several components."""
    counts = rooted.groupBy("slot", "key", "root").agg(F.count("*").alias("n"))
    largest = counts.groupBy("slot", "key").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("k")).where("k > 1").select("slot", "key", F.col("m.root").alias("most"))
    return rooted.join(largest, ["slot", "key"]).select("slot", "key", "node", "root", (F.col("root") == F.col("most")).cast("int").alias("main"))


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets with several components."""
    rooted = shared.select("slot", "key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return _apart(materialise(rooted, "rooted"))


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether a new group begins, rows of one group of sorted rows), in order."""
    last = None
    for batch in batches:
        if len(batch):
            own = np.column_stack([column(batch, c).to_numpy().astype("i8") for c in keys])
            cut = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1).tolist(), len(own)]
            for a, b in itertools.pairwise(cut):
                yield last != tuple(own[a]), batch.slice(a, b - a)
                last = tuple(own[a])


def _signs(batch: pa.RecordBatch, name: str = SIGN) -> np.ndarray:
    return np.frombuffer(b"".join(column(batch, name).to_pylist()), "u1").reshape(-1, HASHES)


def _chosen(sample: DataFrame) -> DataFrame:
    """slot, key, pivot, pivot_root, pivot_sign: a few members of each bucket's sample (with signatures)."""
    keys = ("slot", "key")

    def picked(parts: list[pa.RecordBatch]) -> dict:
        nodes, roots = (np.concatenate([column(x, c).to_numpy() for x in parts]) for c in ("node", "root"))
        signs = np.concatenate(list(map(_signs, parts)))
        rest, at = np.arange(len(nodes)), []
        while len(rest) and len(at) < PIVOTS:
            seen = np.bincount((signs[rest].astype("i8") + 256 * np.arange(HASHES)).ravel(), minlength=256 * HASHES).reshape(HASHES, 256)
            at.append(rest[(signs[rest] == seen.argmax(1)).sum(1).argmax()])
            rest = rest[((signs[rest] == signs[at[-1]]).sum(1) < CLOSE) & (rest != at[-1])]
        n = len(at)
        return {"slot": column(parts[0], "slot").slice(0, 1).to_pylist() * n, "key": column(parts[0], "key").slice(0, 1).to_pylist() * n, "pivot": nodes[at], "pivot_root": roots[at], "pivot_sign": [signs[i].tobytes() for i in at]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        for new, part in _groups(batches, keys):
            if new and held:
                yield picked(held)
                held = []
            held.append(part)
        if held:
            yield picked(held)

    rows = sample.repartition(*keys).sortWithinPartitions(*keys, "node")
    return map_arrow(rows, run, "slot int, key long, pivot long, pivot_root long, pivot_sign binary")


def _pivots(mixed: DataFrame, own: DataFrame) -> DataFrame:
    """Likely pairs a, b of the members of each bucket and its pivots, out of different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keep = pa.array((_signs(batch) == _signs(batch, "pivot_sign")).sum(1) >= AGREE)
            node, pivot = (column(batch, c).filter(keep).to_numpy() for c in ("node", "pivot"))
            yield {"a": np.minimum(node, pivot), "b": np.maximum(node, pivot)}

    first = mixed.withColumn("n", F.row_number().over(Window.partitionBy("slot", "key").orderBy("node"))).where(F.col("n") <= SAMPLE).drop("n")
    chosen = materialise(_chosen(first.join(own, "node")), "pivots")
    met = mixed.join(chosen, ["slot", "key"]).where("root != pivot_root").join(own, "node")
    return map_arrow(met.select("node", SIGN, "pivot", "pivot_sign"), run, "a long, b long").distinct()


def _parted(mixed: DataFrame, shared: DataFrame) -> DataFrame:
    """mixed, but members of a bucket with more than SPLIT of them to hold meet in buckets of two bands instead."""
    sizes = mixed.groupBy("slot", "key").agg(F.sum(1 - F.col("main")).alias("held"))
    over = materialise(sizes.where(F.col("held") > SPLIT).select("slot", "key"), "over")
    if over.isEmpty():
        return mixed
    members = mixed.join(over, ["slot", "key"])
    second = members.join(shared.select(F.col("slot").alias("slot2"), F.col("key").alias("key2"), "node"), "node").where("slot != slot2")
    second = second.select(F.col("slot2").alias("slot"), F.xxhash64("slot", "key", "slot2", "key2").alias("key"), "node", "root")
    return mixed.join(over, ["slot", "key"], "left_anti").unionByName(_apart(materialise(second, "second")))


def _cells(mixed: DataFrame) -> DataFrame:
    """slot, key, i, j, side, node, root: the members that a cell (i, j) of a bucket holds (side 0), and those that pass by (side 1).

    Held chunks meet themselves and each other once; the largest component's members pass by all of them, their first chunk where a held one meets itself.
    """
    sizes = mixed.groupBy("slot", "key").agg(F.sum(1 - F.col("main")).alias("held"), F.sum("main").alias("passing"))
    chunks = lambda n, each: F.greatest(F.ceil(F.col(n) / each), F.lit(1)).cast("int")
    rows = mixed.join(sizes.select("slot", "key", chunks("held", HELD).alias("ch"), chunks("passing", PASSING).alias("cp")), ["slot", "key"])
    own = F.pmod(F.xxhash64("node"), F.when(F.col("main") == 1, F.col("cp")).otherwise(F.col("ch"))).cast("int")
    rows = rows.withColumn("own", own)
    upto = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    zero, one, c, ch, cp = F.lit(0), F.lit(1), F.col("own"), F.col("ch"), F.col("cp")
    holds = F.concat(F.transform(upto(c, ch), lambda j: cell(c, j, 0)), F.transform(upto(one, cp), lambda m: cell(c, ch + m, 0)), F.transform(upto(zero, c), lambda i: cell(i, c, 1)))
    passes = F.transform(upto(zero, ch), lambda i: cell(i, F.when(c == 0, i).otherwise(ch + c), 1))
    at = F.explode(F.when(F.col("main") == 1, passes).otherwise(holds)).alias("at")
    return rows.select("slot", "key", "node", "root", at).select("slot", "key", "at.i", "at.j", "at.side", "node", "root")


def _settled(cells: DataFrame) -> DataFrame:
    """Links a, b that join the near members (with signatures and sets) of each cell; side 1 passes by one batch at a time."""
    keys = ("slot", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        nodes: list[int] = []
        roots: list[int] = []
        sets: list[np.ndarray] = []
        signs = np.zeros((HELD, HASHES), "u1")
        join: dict[int, int] = {}
        a: list[int] = []
        b: list[int] = []

        def find(x: int) -> int:
            while join.get(x, x) != x:
                x = join[x]
            return x

        def tried(k: int, agree: np.ndarray, others: list[int], other_roots: list[int], other_set: Callable[[int], np.ndarray]) -> None:
            """Held member k and those of others whose signatures agree, the likeliest first."""
            for j in np.argsort(-agree, kind="stable")[: int((agree >= AGREE).sum())].tolist():
                mine, its = find(roots[k]), find(other_roots[j])
                if mine != its and near(sets[k], other_set(j)):
                    join[mine] = its
                    a.append(nodes[k])
                    b.append(others[j])

        for new, part in _groups(batches, keys):
            if new:
                nodes, roots, sets, join = [], [], [], {}
            own, side, root = (column(part, x).to_pylist() for x in ("node", "side", "root"))
            own_sets, own_signs = column(part, "own"), _signs(part)
            first = side.index(1) if 1 in side else len(side)
            meets_itself = column(part, "i")[0].as_py() == column(part, "j")[0].as_py()
            for i in range(first):
                k = len(nodes)
                if k == len(signs):
                    signs = np.concatenate([signs, np.zeros_like(signs)])
                signs[k] = own_signs[i]
                nodes.append(own[i])
                roots.append(root[i])
                sets.append(np.frombuffer(own_sets[i].as_py(), "u8"))
                if meets_itself and k:
                    tried(k, (signs[:k] == signs[k]).sum(1), nodes, roots, sets.__getitem__)
            if first < len(side):
                passing, known = own_signs[first:], {}

                def passing_set(j: int) -> np.ndarray:
                    if j not in known:
                        known[j] = np.frombuffer(own_sets[first + j].as_py(), "u8")  # noqa: B023
                    return known[j]  # noqa: B023

                for k in range(len(nodes)):
                    tried(k, (passing == signs[k]).sum(1), own[first:], root[first:], passing_set)
            if a:
                yield {"a": a, "b": b}
                a.clear()
                b.clear()

    rows = cells.repartition(*keys).sortWithinPartitions(*keys, "side", "node")
    return map_arrow(rows, run, "a long, b long")


def similar_links(rows: DataFrame) -> DataFrame:
    """Links a, b between the sets of signed rows, enough to join all that are near."""
    members = materialise(rows.groupBy(SET).agg(F.first(BAND).alias(BAND), F.first(SIGN).alias(SIGN), F.first(PRINT).alias(PRINT)).withColumnRenamed(SET, "node"), "members")
    postings = materialise(_postings(members), "postings")
    # most texts have no near copy: what follows is about the buckets of several members alone
    least = postings.groupBy("slot", "key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = materialise(postings.join(least, ["slot", "key"]).select("slot", "key", "node", "a"), "shared")
    likely = _likely(shared.where("node != a").select("a", F.col("node").alias("b")).distinct(), members)
    tried = materialise(_indexed(members).union(likely).distinct(), "pairs")
    links = _verified(tried, rows)
    own = members.select("node", SIGN)
    pairs = _pivots(materialise(_mixed(shared, components(links)), "apart"), own)
    pairs = materialise(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links if pairs.isEmpty() else links.union(_verified(pairs, rows))
    mixed = materialise(_parted(_mixed(shared, components(links)), shared), "mixed")
    return links.union(materialise(_settled(_cells(mixed).join(own, "node").join(_sets(mixed, rows), "node")), "settled"))


def similar(docs: DataFrame, root: str = "shingle_root", component: str = "component_id") -> DataFrame:
    """docs with the component of each row (`root`) and the least doc_id there (`component`), which must be no columns of docs.

    A null text is empty, and all texts without a word are one component; a null doc_id names no component unless all of
    its members are null. Repeated rows are rows each. Other columns of docs stay, whatever their names; an empty table gives no row.
    """
    taken = {c.lower() for c in docs.columns}
    if taken & {root.lower(), component.lower()}:
        raise ValueError(f"docs has a column {root} or {component}")
    # within, docs' other columns have names that nothing else has
    kept = [c if c in ("doc_id", "text") else f"kept_{i}" for i, c in enumerate(docs.columns)]
    rows = materialise(signed(docs.toDF(*kept)).withColumn(ROW, F.monotonically_increasing_id()), "signed")
    with passing(docs.sparkSession):
        roots = components(similar_links(rows)).toDF(SET, "root")
        own = rows.groupBy(SET).agg(F.min("doc_id").alias("least")).join(roots, SET, "left").withColumn("root", F.coalesce("root", SET))
        own = materialise(own, "own")
        named = materialise(own.join(own.groupBy("root").agg(F.min("least").alias("component")), "root").select(SET, "root", "component"), "named", keep=True)
    # many copies have one set: the hot side is split over tasks by a salt that the other side repeats
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hot = rows.drop(BAND, SIGN, ROW, PRINT).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return hot.join(salted, [SET, "salt"]).select(*kept, "root", "component").toDF(*docs.columns, root, component)


#: Tasks that the documents of one set are dealt to.
SALTS = 16
