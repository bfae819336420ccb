"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its character n-grams and the lexicons that hold it, hashed; their weights and the
transitions between the languages of neighbouring words are learned together by stochastic gradients of the
likelihood, on code-switched sequences put together from spans of labelled documents. Forward-backward gives every
word of a text a posterior over languages; a text's language has the greatest mean posterior, which is its score.
Sequences are runs of at most RUN words, so that all of a batch's are worked through in lockstep.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, least_hashed, map_arrow, slices

#: Labelled documents that the field is fitted on at most, of each language; chosen by a hash of their id.
SAMPLE = 300
RUN = 64
SPACE = 1 << 15
#: Sampled documents of a language that have a word of its lexicon at least.
LEXICON = 2
STEPS, BATCH, LENGTH = 250, 48, 40
#: Words remembered per worker; the memory is emptied when it is full.
REMEMBERED = 300_000
#: A longer run of letters is several words, one behind the other.
WORD = re.compile(r"[^\W\d_]{1,40}")


class Field(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # SPACE x languages
    moves: np.ndarray  # from x to
    first: np.ndarray
    lexicon: dict[str, int]  # a bit for each language


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(40)) % np.uint64(SPACE)).astype("i8")


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, hashed feature) of all features of lower-case words: character n-grams of 2 and 3, beginnings and ends of 2, 3 and 4 with the
    word's edges, words of up to 7 letters, and the lexicons that hold the word."""
    if not words:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    chars = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "u4").astype("u8")
    sizes = np.array(list(map(len, words))) + 2
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    gram = chars
    for n in (2, 3, 4):
        gram = gram[:-1] * np.uint64(0x100000001B3) + chars[n - 1 :] if len(gram) > 1 else gram[:0]
        if n < 4:
            inside = owner[: len(gram)] == owner[n - 1 :]
            out.append((owner[: len(gram)][inside], _mixed(gram[inside], n)))
        own = np.flatnonzero(sizes >= n)
        out += [(own, _mixed(gram[begins[own]], 10 + n)), (own, _mixed(gram[ends[own] - n], 20 + n))]
    place = (np.arange(len(chars)) - begins[owner]).astype("u8")
    whole = np.add.reduceat(chars * (place * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) ** (place % np.uint64(8)), begins)
    short = np.flatnonzero(sizes < 10)
    out.append((short, _mixed(whole[short], 1)))
    bits = np.fromiter((lexicon.get(w, 0) for w in words), "i8", len(words))
    for k in range(int(bits.max()).bit_length()):
        own = np.flatnonzero(bits >> k & 1)
        out.append((own, _mixed(np.full(len(own), k, "u8"), 30)))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def posteriors(scores: np.ndarray, moves: np.ndarray, first: np.ndarray, lengths: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(word posteriors, expected moves) of sequences: scores (rows, words, languages), rows in descending order of length.

    enter, leave: for each row, the forward message into its first word (by default from first) and the backward one into its last.
    """
    rows, steps, k = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    m = np.exp(moves - moves.max())
    a = np.zeros_like(e)
    b = np.ones_like(e)
    a[:, 0] = e[:, 0] * (np.exp(first - first.max()) if enter is None else enter)
    if leave is not None:
        b[np.arange(rows), lengths - 1] = leave
    a[:, 0] /= a[:, 0].sum(1, keepdims=True)
    alive = [int((lengths > t).sum()) for t in range(steps)]
    for t in range(1, steps):
        n = alive[t]
        x = (a[:n, t - 1] @ m) * e[:n, t]
        a[:n, t] = x / x.sum(1, keepdims=True)
    expected = np.zeros((k, k))
    for t in range(steps - 1, 0, -1):
        n = alive[t]
        y = e[:n, t] * b[:n, t]
        x = y @ m.T
        both = a[:n, t - 1][:, :, None] * m[None] * y[:, None, :]
        expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
        b[:n, t - 1] = x / x.sum(1, keepdims=True)
    p = a * b
    return p / np.maximum(p.sum(2, keepdims=True), 1e-300), expected


def marginals(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, first: np.ndarray, run: int = RUN) -> np.ndarray:
    """The posterior of every word of texts that follow each other in scores (words, languages); sizes: words of each text."""
    n, k = scores.shape
    if not n:
        return np.zeros((0, k))
    per = -(-sizes // run)  # runs of each text, which are numbered in a row
    begin = np.r_[0, np.cumsum(per)[:-1]]
    turn = np.arange(int(per.sum())) - np.repeat(begin, per)
    starts = np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], per) + turn * run
    lengths = np.minimum(run, np.repeat(sizes, per) - turn * run)
    order = np.argsort(-lengths, kind="stable")
    steps = int(lengths.max())
    grid = np.minimum(starts[order][:, None] + np.arange(steps), n - 1)
    own, long = scores[grid], lengths[order]
    e, m = np.exp(own - own.max(2, keepdims=True)), np.exp(moves - moves.max())
    enter, leave = np.zeros((len(order), k)), np.ones((len(order), k))
    enter[begin[per > 0]] = np.exp(first - first.max())
    many = np.flatnonzero(per > 1)
    if len(many):
        # each run's words as one matrix, from the message into its first word to the one out of its last
        whole = e[:, 0][:, :, None] * np.eye(k)
        for t in range(1, steps):
            alive = int((long > t).sum())
            x = (whole[:alive] @ m) * e[:alive, t][:, None, :]
            whole[:alive] = x / x.sum((1, 2), keepdims=True)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        whole = whole[back]
        many = many[np.argsort(-per[many], kind="stable")]
        for t in range(1, int(per.max())):
            at = begin[many[: int((per[many] > t).sum())]] + t
            x = np.einsum("ri,rij->rj", enter[at - 1], whole[at - 1]) @ m
            enter[at] = x / x.sum(1, keepdims=True)
        for t in range(int(per.max()) - 1, 0, -1):
            at = begin[many[: int((per[many] > t).sum())]] + t
            x = np.einsum("rij,rj->ri", whole[at], leave[at]) @ m.T
            leave[at - 1] = x / x.sum(1, keepdims=True)
    p, _ = posteriors(own, moves, first, long, enter[order], leave[order])
    out = np.zeros((n, k))
    inside = np.arange(steps) < long[:, None]
    out[grid[inside]] = p[inside]
    return out


def fit(rows: list[tuple[str, str]], seed: int = 11) -> Field | None:
    """The field of (text, language) rows; None without words. Deterministic."""
    texts: dict[str, list[list[str]]] = {}
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        if words := WORD.findall(text.lower()):
            texts.setdefault(lang, []).append(words)
            counts.setdefault(lang, Counter()).update(set(words))
    languages = sorted(texts)
    if not languages:
        return None
    lexicon: dict[str, int] = {}
    for k, lang in enumerate(languages):
        for w in sorted(w for w, c in counts[lang].items() if c >= LEXICON):
            lexicon[w] = lexicon.get(w, 0) | 1 << k
    n, rng = len(languages), np.random.default_rng(seed)
    weights, moves, first = np.zeros((SPACE, n)), np.zeros((n, n)), np.zeros(n)
    g_w, g_m, g_f = np.full((SPACE, n), 1e-3), np.full((n, n), 1e-3), np.full(n, 1e-3)
    for _ in range(STEPS if n > 1 else 0):
        seqs, gold = [], np.zeros((BATCH, LENGTH), "i8")
        for r in range(BATCH):
            words: list[str] = []
            while len(words) < LENGTH:
                k = int(rng.integers(n))
                doc = texts[languages[k]][int(rng.integers(len(texts[languages[k]])))]
                at = int(rng.integers(len(doc)))
                span = doc[at : at + int(rng.integers(4, 30))][: LENGTH - len(words)]
                gold[r, len(words) : len(words) + len(span)] = k
                words += span
            seqs.append(words)
        owner, flat = features([w for words in seqs for w in words], lexicon)
        scores = np.stack([np.bincount(owner, weights[flat, k], BATCH * LENGTH) for k in range(n)], 1).reshape(BATCH, LENGTH, n)
        p, expected = posteriors(scores, moves, first, np.full(BATCH, LENGTH))
        error = p - np.eye(n)[gold]
        grad = np.stack([np.bincount(flat, error.reshape(-1, n)[owner, k], SPACE) for k in range(n)], 1) / BATCH
        seen = np.zeros((n, n))
        np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        for x, g, total in ((weights, grad, g_w), (moves, (expected - seen) / BATCH, g_m), (first, error[:, 0].sum(0) / BATCH, g_f)):
            total += g * g
            x -= 0.3 * g / np.sqrt(total)
    return Field(languages, weights, moves, first, lexicon)


class Labeller:
    """A field and the scores of the words that a worker has met."""

    def __init__(self, field: Field):
        self.field = field
        self.weights = np.ascontiguousarray(field.weights.T)
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(field.languages)))

    def _learn(self, words: set[str]) -> None:
        if len(self.place) > REMEMBERED:
            self.place, self.scores = {}, self.scores[:0]
        new = list(words.difference(self.place))
        if not new:
            return
        owner, flat = features(new, self.field.lexicon)
        sums = np.stack([np.bincount(owner, own[flat], len(new)) for own in self.weights], 1)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, sums])

    def label(self, texts: list[str]) -> list[list[tuple[str, np.ndarray]]]:
        """Every text's words with their posteriors over the languages."""
        words, p = self._run(texts)
        ends = np.cumsum([0, *map(len, words)])
        return [list(zip(ws, p[a:b], strict=True)) for ws, a, b in zip(words, ends[:-1], ends[1:], strict=True)]

    def _run(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray]:
        words = [WORD.findall(t.lower()) for t in texts]
        self._learn(set().union(*words))
        n = sum(map(len, words))
        place = self.place.__getitem__
        ids = np.fromiter((i for ws in words for i in map(place, ws)), "i8", n)
        return words, marginals(self.scores[ids], np.array(list(map(len, words)), "i8"), self.field.moves, self.field.first)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        words, p = self._run(texts)
        sizes = np.array(list(map(len, words)))
        owner = np.repeat(np.arange(len(words)), sizes)
        mean = np.stack([np.bincount(owner, p[:, k], len(words)) for k in range(p.shape[1])], 1) / np.maximum(sizes, 1)[:, None]
        best = mean.argmax(1)
        return [(self.field.languages[b], min(1.0, float(m[b]))) if ws and any(c.isalpha() for w in ws for c in w) else ("und", 0.0) for b, m, ws in zip(best.tolist(), mean, words, strict=True)]


_labellers: dict[int, Labeller] = {}


def sample(docs: DataFrame, most: int = SAMPLE) -> Field | None:
    """The field of at most `most` documents of each language (a column lang)."""
    rows = docs.where("lang is not null and text is not null")
    # ids first, as columns; then, as an id may have many rows, rows again
    hashed = rows.withColumn("h", F.xxhash64("doc_id"))
    ids = least_hashed(hashed.select("lang", "doc_id", "h"), "lang", F.lit(most), ["doc_id"]).select("lang", "doc_id").distinct()
    picked = least_hashed(hashed.select("lang", "doc_id", "text", "h").join(F.broadcast(ids), ["lang", "doc_id"]), "lang", F.lit(most), ["doc_id", "text"])
    got = [tuple(r) for r in picked.select("doc_id", "text", "lang").collect()]
    return fit([r[1:] for r in sorted(got, key=lambda r: (str(r[0]), r[1], r[2]))])


def languages(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score of every row's whole text; languages are learned from train's text and lang.

    `und` and 0 for a text that is null or has no letter, and for every text if train has no labelled words. Repeated
    rows are predicted alike; other columns are left out and never looked at. No shuffle.
    """
    field = sample(train)
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        field = held.value
        if field is not None and id(field) not in _labellers:
            _labellers.clear()
            _labellers[id(field)] = Labeller(field)
        for batch in batches:
            for a, texts in slices(batch):
                got = _labellers[id(field)].predict(texts) if field is not None else [("und", 0.0)] * len(texts)
                yield {"doc_id": column(batch, "doc_id").slice(a, len(texts)), "lang_pred": [x for x, _ in got], "score": [s for _, s in got]}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def forget() -> None:
    _labellers.clear()
