"""Which tokens of one tokenizer stand for which of another, over a corpus.

A and B are the tokens of a text behind a space; both spell the same bytes. Tokens are the nodes of a bipartite graph, an edge for
every A and B token whose byte ranges overlap; its connected components, found by union-find, are the smallest groups of tokens
that begin and end together. The members of a component give the links: the A and B tokens in it whose ranges end together. Links are counted
over the corpus by pairs of ids, in partial aggregates, and the counts are met again with the texts' own pairs.

A slice of texts goes through numpy as one row of bytes: ends of tokens are running sums, edges are found by binary search (there are no
more of them than tokens), and all components of the slice are united at once, by hooking roots to lesser ones and jumping to the
roots' roots. Ids of words behind a space are remembered by worker, as in tokens.py; texts where that doesn't hold go to the library whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, materialise, slices
from .tokens import NO_SPACE, WORDS, PieceEncoder, flat_ids

#: Pairs of ids that are broadcast at most; see most_pairs().
BROADCAST_PAIRS = 4_000_000
MARK = "▁"


class SpacedBytes(PieceEncoder):
    """Ids of a byte-level BPE model of texts that stand behind a space; special strings are plain text."""

    def __init__(self, path: str, words: int = WORDS):
        super().__init__(path, words)
        self.library.encode_special_tokens = True
        # the 256 bytes are spelled by printable characters: those of two Latin ranges by themselves, others from U+0100 on, in order
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spelled = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        names = {i: x for x, i in self.library.get_vocab(with_added_tokens=False).items()}
        added = {i: x.content.encode() for i, x in self.library.get_added_tokens_decoder().items()}
        self.spelled = [bytes(spelled[c] for c in names[i]) if i in names and i not in added else added.get(i, b"") for i in range(1 + max([*names, *added]))]

    def whole(self, texts: list[str]) -> list[array]:
        return self._ids([f" {t}" for t in texts])

    def spaced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many of each text)."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        where = coded.indices.to_numpy()
        row = pc.index_in(coded.dictionary, value_set=self.known).fill_null(-2).to_numpy() + np.int32(1)
        new = np.flatnonzero(row < 0)
        fresh = coded.dictionary.take(new).to_numpy(zero_copy_only=False).tolist()
        stands = self._standing(fresh, texts)
        flat, sizes = self._spaced([w for w, x in zip(fresh, stands.tolist(), strict=True) if x])
        # rows behind the remembered ones; row 0 is for words that can't stand alone
        row[new[~stands]] = 0
        row[new[stands]] = np.arange(len(sizes)) + len(self.begins)
        begins = np.r_[self.begins, (len(self.flat) + np.cumsum(sizes) - sizes).astype("i4")]
        sizes = np.r_[self.sizes, sizes.astype("i4")]
        flat = np.concatenate([self.flat, flat])
        keep = min(len(sizes) - len(self.sizes), max(0, self.most - len(self.known)))
        if keep:
            rows = len(self.begins) + keep
            self.known = pa.concat_arrays([self.known, coded.dictionary.take(new[stands][:keep])])
            self.begins, self.sizes, self.flat = begins[:rows], sizes[:rows], flat[: int(begins[rows - 1] + sizes[rows - 1])]
        counts, source = sizes[row][where].astype("i8"), begins[row][where].astype("i8")
        odd = np.flatnonzero(np.add.reduceat((row == 0)[where], at[:-1]))
        if len(odd):
            wholes = self.whole([texts[i] for i in odd.tolist()])
            lengths = np.array(list(map(len, wholes)))
            counts[np.repeat(np.isin(np.arange(len(texts)), odd), np.diff(at))] = 0
            counts[at[odd]], source[at[odd]] = lengths, len(flat) + np.cumsum(lengths) - lengths
            flat = np.concatenate([flat, flat_ids(wholes)])
        place = np.repeat(source - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return flat[place], np.add.reduceat(counts, at[:-1])


class SpacedPieces(SpacedBytes):
    """Ids of a sentencepiece model that puts a word mark in front of a text."""

    def __init__(self, path: str, words: int = WORDS):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.known = words, pa.array([], pa.large_string())
        self.begins, self.sizes, self.flat = np.zeros(1, "i4"), np.zeros(1, "i4"), np.zeros(0, "u4")
        n = self.library.get_piece_size()
        piece = self.library.id_to_piece
        self.spelled = [bytes([int(piece(i)[3:-1], 16)]) if self.library.is_byte(i) else piece(i).replace(MARK, " ").encode() for i in range(n)]
        if any(MARK in piece(i).lstrip(MARK) for i in range(n)):
            raise ValueError("an entry reaches over the beginning of a word")

    def whole(self, texts: list[str]) -> list[array]:
        return [array("I", x) for x in self.library.encode(texts, num_threads=1)]

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.whole(words)
        return flat_ids(ids), np.array(list(map(len, ids)), "i8")

    def _standing(self, words: list[str], texts: list[str]) -> np.ndarray:
        return np.array([w != "" and MARK not in w and NO_SPACE not in w for w in words], bool)


@lru_cache(maxsize=4)
def encoder(path: str) -> SpacedBytes:
    """One encoder per file and worker process."""
    return SpacedPieces(path) if path.endswith(".model") else SpacedBytes(path)


@lru_cache(maxsize=4)
def spelled(path: str) -> tuple[np.ndarray, list[bytes]]:
    """(bytes, and their number) of each id."""
    words = encoder(path).spelled
    return np.array(list(map(len, words)), "i8"), words


@lru_cache(maxsize=1)
def _names(n: int) -> list[str]:
    """Ids below n in decimal with what follows: a comma, a bar or a semicolon, in turn."""
    return [f"{i}{c}" for i in range(n) for c in ",|;"]


def forget() -> None:
    for x in (encoder, spelled, _names):
        x.cache_clear()


def most_pairs(a_path: str, b_path: str) -> int:
    """An upper bound of the pairs of ids that can end together, by the vocabularies alone: of two such tokens one is an end of the other.

    A token has as many ends as bytes; several ids may spell one end.
    """
    a, b = spelled(a_path)[1], spelled(b_path)[1]
    same: dict[bytes, int] = {}
    for x in (*a, *b):
        same[x] = same.get(x, 0) + 1
    return sum(same.get(x[i:], 0) for xs in (a, b) for x in xs for i in range(len(x)))


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected to by edges u[i] - v[i]: union-find, all edges at once."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) between tokens whose byte ranges overlap; both sides tile the same bytes, no token is empty."""
    a_start, b_start = np.r_[0, a_end][:-1], np.r_[0, b_end][:-1]
    first, last = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = last - first
    a = np.repeat(np.arange(len(a_end)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _fitting(texts: list[str], flat: np.ndarray, n: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Which texts, behind a space, their tokens spell."""
    want = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
    got = list(map(words.__getitem__, flat.tolist()))
    ends = np.cumsum(n).tolist()
    return np.array([b"".join(got[e - k : e]) == w for e, k, w in zip(ends, n.tolist(), want, strict=True)], bool)


def align(texts: list[str], a_path: str, b_path: str) -> tuple[np.ndarray, ...]:
    """For each text n_a, n_b, n_groups; its groups, spelled; and the links of all texts: text, a, b. Texts that don't fit have nothing."""
    sides = []
    for path in (a_path, b_path):
        flat, n = encoder(path).spaced(texts)
        sides.append((flat, n, *spelled(path)))
    good = np.array([t != "" for t in texts], bool)
    for flat, n, _, words in sides:
        good &= _fitting(texts, flat, n, words)
    ids, ends, text = [], [], []
    for flat, n, size, _ in sides:
        flat = flat[np.repeat(good, n)].astype("i8")
        n[~good] = 0
        ids.append(flat)
        ends.append(np.cumsum(size[flat]))
        text.append(np.repeat(np.arange(len(texts)), n))
    (a, b), (a_end, b_end) = ids, ends
    n_a, n_b = (s[1] for s in sides)
    u, v = overlaps(a_end, b_end)
    root = components(len(a) + len(b), u, v + len(a))
    # A's nodes come first, so that a component's root is its first A token; components lie one behind the other
    opens = root[: len(a)] == np.arange(len(a))
    a_group = np.cumsum(opens) - 1
    b_group = a_group[root[len(a) :]]
    groups = np.bincount(text[0][opens], minlength=len(texts))
    # links: members of a component that end together
    j = np.searchsorted(b_end, a_end)
    linked = np.flatnonzero((b_end[j] == a_end) & (b_group[j] == a_group)) if len(b) else np.zeros(0, "i8")
    # groups in order, A's members first: each token's place, and what follows it
    k = int(opens.sum())
    in_a, in_b = np.bincount(a_group, minlength=k), np.bincount(b_group, minlength=k)
    code = np.zeros(len(a) + len(b), "i8")
    code[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[a_group]] = 3 * a + np.r_[a_group[1:] != a_group[:-1], True][: len(a)]
    code[np.arange(len(b)) + np.cumsum(in_a)[b_group]] = 3 * b + 2 * np.r_[b_group[1:] != b_group[:-1], True][: len(b)]
    names = _names(max(len(s[3]) for s in sides)).__getitem__
    parts = code.tolist()
    spell = ["".join(map(names, parts[e - m : e]))[:-1] for e, m in zip(np.cumsum(n_a + n_b).tolist(), (n_a + n_b).tolist(), strict=True)]
    return n_a, n_b, groups, spell, text[0][linked], a[linked], b[j[linked]]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), pairs (a, b, times: a text's links by their ids) of every row; no shuffle.

    A text that is null or empty, or that a side doesn't spell byte by byte, has no tokens: zeros, '' and no pairs. Repeated rows have the
    same values each; a null doc_id stays; an empty table gives none; other columns are left out, whatever their names.
    """
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keys = column(batch, "doc_id")
            for first, texts in slices(batch):
                n_a, n_b, groups, spell, text, a, b = align(texts, a_path, b_path)
                # a text's equal links are one pair; ids take 20 bits each, texts of a slice the rest
                code, times = np.unique(text << 40 | a << 20 | b, return_counts=True)
                low = (1 << 20) - 1
                pairs = pa.StructArray.from_arrays([pa.array((x).astype("i4")) for x in (code >> 20 & low, code & low, times)], fields=list(pair))
                offsets = np.searchsorted(code, np.arange(len(texts) + 1) << 40).astype("i4")
                yield {
                    "doc_id": keys.slice(first, len(texts)),
                    "n_a": n_a,
                    "n_b": n_b,
                    "n_groups": groups,
                    "n_links": np.bincount(text, minlength=len(texts)),
                    "groups": spell,
                    "pairs": pa.ListArray.from_arrays(pa.array(offsets), pairs),
                }

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<a:int,b:int,times:int>>")


def pair_counts(texts: DataFrame) -> DataFrame:
    """a, b, count (links over all texts), best (whether no pair of this b has more) of aligned() texts."""
    counts = texts.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.times").alias("count"))
    counts = materialise(counts, "pairs")
    most = counts.groupBy(F.col("b").alias("own")).agg(F.max("count").alias("most"))
    return counts.join(most, counts["b"] == most["own"]).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row, as aligned() and pair_counts() have them; '' has no digest."""
    texts = aligned(docs, a_path, b_path).withColumn("groups_sha256", F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))).drop("groups")
    texts = materialise(texts.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialise(pair_counts(texts), "counts")
    # the bound is the vocabularies', whatever the corpus
    counts = F.broadcast(counts) if most_pairs(a_path, b_path) <= BROADCAST_PAIRS else counts
    own = texts.select("row", F.explode("pairs").alias("p")).select("row", "p.a", "p.b", "p.times").join(counts, ["a", "b"])
    sums = own.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return texts.drop("pairs").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
