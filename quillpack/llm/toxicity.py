"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior.

Voters look at one text each. A lexicon voter holds a word, a pattern voter the beginning of words; either votes for class 1 if a text
has its feature so many times (once, twice, three times), and abstains if not. Three more patterns know no words: shouting, marks in rows, one word
over and over. Which voters there are is learned from a bounded sample of labelled rows, whose texts are seen whole: a
feature must be likelier in class 1, and more so than chance explains for the number of features tried.

The label model is a mixture of two classes over the votes alone. Every voter has a probability of voting in either class, its accuracy,
estimated by expectation-maximisation under a Dirichlet prior that the sampled labels give; no label is a vote. Voters that agree more often within a class than
their accuracies explain share one vote: the correlation of each pair is estimated from the residuals of their votes
and lowers their weight. The classifier, a logistic regression over the voters' features, is fitted to
the posterior, so that labels which no voter bears out are not learned, and scores whole texts.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, least_hashed, map_arrow, slices

#: Labelled rows that the model is fitted on at most, of class 1 and of class 0; chosen by a hash of their id.
SAMPLE, SAMPLE_CLEAN = 2000, 5000
WORD = re.compile(r"[^\W\d_]+")
#: Words of a text in which a feature must be several times for such a voter; more in a longer text, in proportion.
PER = 300
#: Characters of the beginnings that pattern voters hold, and how often a feature must be in a text for a voter of its own.
BEGINNINGS, TIMES = (3, 4, 5, 6, 7, 8), (1, 2, 3)
#: A voter's feature must be so much likelier in class 1 (logarithm), and its texts so unlikely by chance
#: (logarithm, above the one of the number of features tried).
EVIDENCE, SURPRISE = 2.5, 4.0
#: Parts of least hashes that near copies have in common.
AGREE = 0.7
#: Texts with this much of their words shouted, marks in rows, or one word.
MUCH = 0.5
#: Squared correlation, within the classes, above which voters share their votes.
TIED = 0.25
#: Weight of the prior that the sampled labels give, in parts of the sample; ridge of the classifier.
PRIOR, RIDGE = 1.0, 0.02
CUT = 0.7


class Model(NamedTuple):
    """weights of (feature, times): a word, or a beginning behind a mark."""

    weights: dict[tuple[str, int], float]
    bias: float

    def index(self) -> Index:
        return Index(self.weights)


class Index:
    """Which of some features texts have."""

    def __init__(self, features: Iterable[tuple[str, int]]):
        self.times: dict[str, list[int]] = {}
        for f, n in features:
            self.times.setdefault(f, []).append(n)
        self.words = {f for f in self.times if f[0] != "^"}
        self.stems = {n: {f[1:] for f in self.times if f[0] == "^" and len(f) == n + 1} for n in BEGINNINGS}

    def found(self, text: str) -> list[tuple[str, int]]:
        """In order."""
        seen = Counter(WORD.findall(text.lower()))
        counts: dict[str, int] = {w: seen[w] for w in self.words.intersection(seen)}
        for n, stems in self.stems.items():
            if stems:
                for w in seen:
                    if w[:n] in stems:
                        f = "^" + w[:n]
                        counts[f] = counts.get(f, 0) + seen[w]
        long = max(1.0, seen.total() / PER)
        return sorted((f, k) for f, n in counts.items() for k in self.times[f] if k == 1 or n >= k * long)


class Features:
    """Hashes of all features of texts, of which voters are chosen: words, and their beginnings, so many times."""

    def __init__(self):
        self.words: dict[str, np.ndarray] = {}

    @staticmethod
    def names(word: str) -> list[str]:
        return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]

    def of(self, text: str) -> np.ndarray:
        seen = Counter(WORD.findall(text.lower()))
        if not seen:
            return np.zeros(0, "u8")
        for w in seen:
            if w not in self.words:
                self.words[w] = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in self.names(w)], "u8")
        parts = [self.words[w] for w in seen]
        found, where = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(where, np.repeat([*seen.values()], list(map(len, parts))))
        long = max(1.0, seen.total() / PER)
        return np.sort(np.concatenate([found, *(found[counts >= k * long] * np.uint64(2 * k + 1) for k in TIMES if k > 1)]))


def surprise(k: int, n: int, q: float) -> float:
    """How unlikely it is, as a logarithm, that k of n texts are of class 1 if its share is q; 0 if they are fewer."""
    r = k / max(n, 1)
    return k * math.log(r / q) + ((n - k) * math.log((1 - r) / (1 - q)) if n > k else 0) if r > q else 0.0


def copies(texts: list[str]) -> list[int]:
    """A number for each text, the same for texts whose sets of words are near copies: 64 least hashes agree in AGREE parts or more."""
    empty = 1 << 32
    signs = np.full((len(texts), 64), empty, "i8")
    for row, t in zip(signs, texts, strict=True):
        h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in set(t.lower().split())], "i8")
        np.minimum.at(row, h & 63, h)
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k in range(0, 64, 4):
        first: dict[bytes, int] = {}
        for i in range(len(texts)):
            if signs[i, k : k + 4].min() < empty:
                j = first.setdefault(signs[i, k : k + 4].tobytes(), i)
                if find(i) != find(j):
                    filled = (signs[i] < empty) | (signs[j] < empty)
                    if (signs[i] == signs[j])[filled].mean() >= AGREE:
                        root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def held_features(texts: list[str], labels: np.ndarray) -> list[tuple[str, int]]:
    """The features that speak for class 1. Evidence is counted by groups of near copies: what only the copies of one text share says nothing."""
    group, hashed = copies(texts), Features()
    ones, zeros = ([(g, t) for g, t, y in sorted(zip(group, texts, labels, strict=True), key=lambda x: x[0]) if bool(y) == wanted] for wanted in (True, False))

    def by_group(rows: list[tuple[int, str]]) -> Iterator[np.ndarray]:
        for _, own in itertools.groupby(rows, lambda x: x[0]):
            yield np.unique(np.concatenate([hashed.of(t) for _, t in own]))

    keys, toxic = np.unique(np.concatenate([*by_group(ones)]), return_counts=True)
    tried = len(keys)
    keys, toxic = keys[toxic > 1], toxic[toxic > 1]
    clean = np.zeros(len(keys), "i8")
    for own in by_group(zeros):
        at = np.searchsorted(keys, own)
        clean[at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == own)] if len(keys) else []] += 1
    n1, n0 = len({g for g, _ in ones}), len({g for g, _ in zeros})
    q, least = n1 / (n1 + n0), SURPRISE + math.log(tried + 1)
    strong = np.log((toxic + 0.1) / (n1 + 1)) - np.log((clean + 0.1) / (n0 + 1)) > EVIDENCE
    told = {k: s for k, c1, c0 in zip(keys[strong].tolist(), toxic[strong].tolist(), clean[strong].tolist(), strict=True) if (s := surprise(c1, c1 + c0, q)) > least}
    # the names of the features that are left, and the groups that have them
    found: dict[tuple[str, int], float] = {}
    for w, own in hashed.words.items():
        for name, h in zip(Features.names(w), own.tolist(), strict=True):
            found |= {(name, k): told[x] for k in TIMES if (x := h * (2 * k + 1 if k > 1 else 1) % 2**64) in told}
    del hashed, keys
    index = Index(found)
    has: dict[tuple[str, int], set[int]] = {f: set() for f in found}
    clean: dict[tuple[str, int], set[int]] = {f: set() for f in found}
    for rows, held_by in ((ones, has), (zeros, clean)):
        for g, t in rows:
            for f in index.found(t):
                held_by[f].add(g)
    # a word, its beginnings and their numbers are related: the best of them is held, and others if the texts that it leaves still speak for them
    held, seen1, seen0 = [], {}, {}
    for f in sorted(found, key=lambda f: (-found[f], f[1], len(f[0].lstrip("^")), f)):
        family = f[0].lstrip("^")[: BEGINNINGS[0]]
        old1, old0 = seen1.setdefault(family, set()), seen0.setdefault(family, set())
        new1, new0 = has[f] - old1, clean[f] - old0
        if surprise(len(new1), len(new1) + len(new0), q) > SURPRISE:
            held.append(f)
            old1 |= new1
            old0 |= new0
    return held


def patterns(text: str) -> list[bool]:
    """Votes of the patterns that know no words."""
    words = WORD.findall(text)
    n = max(1, len(words))
    most = max(Counter(words).values(), default=0)
    return [sum(len(w) > 1 and w.isupper() for w in words) > MUCH * n, len(re.findall(r"([^\w\s])\1", text)) > MUCH * n, n > 20 and most > MUCH * n]


def votes_of(found: list[list[tuple[str, int]]], texts: list[str], held: list[tuple[str, int]]) -> np.ndarray:
    """Whether each voter votes, for each text; found: the held features that each text has. The last one votes where no feature does."""
    place = {f: k for k, f in enumerate(held)}
    out = np.zeros((len(texts), len(held) + 4), bool)
    for i, (fs, t) in enumerate(zip(found, texts, strict=True)):
        out[i, [place[f] for f in fs]] = True
        out[i, len(held) : -1] = patterns(t)
        out[i, -1] = not fs
    return out


class Voters(NamedTuple):
    """yes, no: each voter's probability of voting in class 1 and in class 0; share: the part of its vote that is its own; base: of class 1."""

    yes: np.ndarray
    no: np.ndarray
    share: np.ndarray
    base: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of class 1, for each row of votes; who abstains says nothing."""
        z = math.log(self.base / (1 - self.base)) + votes @ (self.share * np.log(self.yes / self.no))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: np.ndarray, labels: np.ndarray, prior: float = PRIOR, rounds: int = 50) -> Voters:
    """The voters, by expectation-maximisation. labels give the prior of their accuracies and the first posterior, and no vote."""
    x, y = votes.astype("f8"), labels.astype("f8")
    n, p, base = len(y), y, float((y.sum() + 1) / (len(y) + 2))
    seen1, seen0 = prior * (y @ x) + 0.1, prior * ((1 - y) @ x) + 0.1
    n1, n0 = prior * y.sum() + 0.2, prior * (1 - y).sum() + 0.2
    for _ in range(rounds):
        a, b = (seen1 + p @ x) / (n1 + p.sum()), (seen0 + (1 - p) @ x) / (n0 + (1 - p).sum())
        # what is left of the votes when the classes are accounted for: voters that it ties together share a vote
        rest = x - np.outer(p, a) - np.outer(1 - p, b)
        rest /= np.sqrt((rest**2).mean(0)) + 1e-9
        tie = np.maximum(rest.T @ rest / n, 0) ** 2
        share = 1 / np.maximum(1.0, np.where(tie > TIED, tie, 0).sum(1))
        model = Voters(a, b, share, base)
        now = model.posterior(x)
        if np.abs(now - p).max() < 1e-6:
            break
        p = now
    return model


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights, the bias last, that fit the soft labels p, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-6
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (p - q) - pull * w)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], labels: list[int]) -> Model:
    """Deterministic. Without rows of both classes the score is the prior everywhere."""
    y = np.array(labels, bool)
    if not len(y) or y.all() or not y.any():
        return Model({}, 6.0 if len(y) and y.all() else -6.0)
    held = held_features(texts, y)
    index = Index(held)
    votes = votes_of([index.found(t) for t in texts], texts, held)
    p = label_model(votes, y).posterior(votes)
    w = logistic(votes[:, : len(held)].astype("f8"), p)
    return Model(dict(zip(held, w[:-1].tolist(), strict=True)), float(w[-1]))


def sample(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (SAMPLE_CLEAN, SAMPLE)) -> Model:
    """The model of at most so many labelled documents of class 0 and 1."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    # a labelled id may have no document, or many: ids with one are picked, then rows of theirs
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    known = own.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    got = []
    for y in (0, 1):
        ids = least_hashed(known.where(F.col("y") == y), "y", F.lit(most[y]), ["doc_id"])
        picked = least_hashed(rows.join(F.broadcast(ids), "doc_id"), "y", F.lit(most[y]), ["doc_id", "text"])
        got += [tuple(r) for r in picked.select("doc_id", "text", "y").collect()]
    got.sort(key=lambda r: (r[0], r[1]))
    return fit([r[1] for r in got], [r[2] for r in got])


def scored(docs: DataFrame, model: Model, score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (doc_id by default) and the score of each row's whole text. No shuffle."""
    keep = keep or ["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        weights, bias = held.value
        index = held.value.index()
        for batch in batches:
            for a, texts in slices(batch):
                z = [bias + math.fsum(weights[f] for f in index.found(t)) for t in texts]
                yield {c: column(batch, c).slice(a, len(texts)) for c in keep} | {score: [1 / (1 + math.exp(-min(max(x, -30), 30))) for x in z]}

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{score}` double")


def toxic_scores(docs: DataFrame, labels: DataFrame, train: DataFrame | None = None, cut: float = CUT) -> DataFrame:
    """doc_id, score and predicted of every row; labels are learned from `train` (docs by default) with `labels`.

    A null text is empty and scores as a text without a feature; repeated rows score alike; without usable labels the
    score is 0.002; other columns are left out and never looked at.
    """
    model = sample(docs if train is None else train, labels)
    return scored(docs, model).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, train: DataFrame | None = None, cut: float = CUT) -> DataFrame:
    """The rows of docs that score under the cut, with all their columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return scored(docs, sample(docs if train is None else train, labels), name, docs.columns).where(F.col(name) < cut).drop(name)
