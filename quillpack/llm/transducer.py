"""A byte-pair tokenizer compiled into a deterministic transducer whose transitions carry token counts.

Merging by rank, equal ranks from left to right, has two properties:

* an encoding cut at one of its token boundaries is the encoding of the text cut there;
* [.., u, t] encodes a text exactly if [.., u] encodes it without t, and the pair u t encodes to itself.

So every prefix of a text has one last token, found among the vocabulary's entries that end there, and holds one
token more than the prefix in front of that token. A state is thus a node of the trie with failure links (the
longest end of the text that begins an entry) with the last tokens and counts in front of the ends that the node
stands for; a transition is the look-up of a node, of the entries that end there, longest first, and of whether the
pair is stable, and emits the difference of the counts. Nodes, transitions and pairs are compiled as texts need them.

No entry holds a character followed by a word mark: where one follows the other, every state goes to the same state.
The map of a chunk that begins with a word mark, from entry state to (exit state, count), is therefore a constant.
A slice of texts is cut into such chunks. The maps of its distinct chunks are worked out side by side: each is a lane, and
a step takes the next character of all lanes through transitions kept in arrays. The composition of constant maps adds
their counts, so a running sum over all chunks of the slice is their prefix scan, and a text's tokens are the
difference of two of its places. A chunk of many characters is cut anywhere; a Map then keeps the characters up to the first two
that no entry holds together as its head. Maps compose associatively, and a scan over them in pairs gives the whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
#: A chunk longer than this many characters is cut and its parts' maps composed.
CHUNK = 64
#: Chunks worked out side by side.
LANES = 1 << 14
#: Stable pairs remembered per worker (those met first); others are worked out again.
PAIRS = 1_000_000
START = 0


class Table:
    """Whole numbers above 0 to whole numbers from 0, many look-ups at a time."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.zeros(1 << bits, "i8"), np.zeros(1 << bits, "i4")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype("i8")

    def get(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that the table hasn't."""
        at = self._slot(keys)
        found, out = self.keys[at], self.values[at]
        left = np.flatnonzero(found != keys)
        while len(left):
            none = found[left] == 0
            out[left[none]] = -1
            left = left[~none]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found[left], out[left] = self.keys[at[left]], self.values[at[left]]
            left = left[found[left] != keys[left]]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are new and distinct; at most half of the slots are taken."""
        self.size += len(keys)
        if self.size << 1 > len(self.keys):
            held = self.keys > 0
            keys, values = np.r_[self.keys[held], keys], np.r_[self.values[held], values]
            self.bits = max(16, self.size.bit_length() + 1)
            self.keys, self.values = np.zeros(1 << self.bits, "i8"), np.zeros(1 << self.bits, "i4")
        at = self._slot(keys)
        while len(keys):
            # of the keys that meet in a free slot, the first takes it
            free = np.flatnonzero(self.keys[at] == 0)
            slots, which = np.unique(at[free], return_index=True)
            took = free[which]
            self.keys[slots], self.values[slots] = keys[took], values[took]
            rest = np.ones(len(keys), bool)
            rest[took] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & ((1 << self.bits) - 1)


class State(NamedTuple):
    """node, and last tokens and counts of the text's last prefixes, as many as the longest entry has characters."""

    node: int
    last: tuple[int, ...]
    count: tuple[int, ...]


class Map(NamedTuple):
    """head: what must be run from the entry state; then a constant: tokens counted behind it, and the exit state (None: all is head)."""

    head: str
    count: int
    exit: State | None


class Transducer:
    """scores: entries and when they merge (higher first); a character without an entry counts as its UTF-8 bytes."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.names = ["", *scores]
        number = {p: i for i, p in enumerate(self.names)}
        self.children: list[dict[str, int]] = [{}]
        texts = [""]
        for p in scores:
            node = 0
            for c in p:
                at = self.children[node].get(c)
                if at is None:
                    at = self.children[node][c] = len(texts)
                    texts.append(texts[node] + c)
                    self.children.append({})
                node = at
        where = {t: i for i, t in enumerate(texts)}
        self.fail = [next(where[t[k:]] for k in range(1, len(t) + 1) if t[k:] in where) if t else 0 for t in texts]
        self.ends = [tuple((len(t) - k, number[t[k:]]) for k in range(len(t)) if t[k:] in scores) for t in texts]
        self.single = {p for p in scores if len(p) == 1}
        self.beside = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.moves: list[dict[str, int]] = [{} for _ in texts]
        self.pairs: dict[int, bool] = {}
        # the same for lanes: characters by number, entries that end at a node in a row, transitions and pairs met so far
        self.characters = np.full(0x110000, -1, "i4")
        self.characters[[ord(c) for c in self.single]] = np.arange(len(self.single))
        self.begins = np.cumsum([0, *map(len, self.ends)])
        self.end_size, self.end_entry = np.array([e for ends in self.ends for e in ends], "i4").reshape(-1, 2).T.copy()
        self.moved, self.stable = Table(), Table()
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("an entry reaches over the beginning of a word")

    def merge(self, text: str) -> list[str]:
        """The encoding by its definition; for texts of two entries' length."""
        out = list(text)
        while len(out) > 1:
            best, at = None, 0
            for i in range(len(out) - 1):
                s = self.scores.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def _move(self, node: int, c: str) -> int:
        """-1: no entry has this character."""
        at = node
        if c not in self.single:
            to = -1
        else:
            while c not in self.children[at]:
                at = self.fail[at]
            to = self.children[at][c]
        self.moves[node][c] = to
        return to

    def _pair(self, u: int, t: int) -> bool:
        a, b = self.names[u], self.names[t]
        found = self.merge(a + b) == ([a, b] if a else [b])
        if len(self.pairs) < PAIRS:
            self.pairs[u << 20 | t] = found
        return found

    start = State(0, (START,), (0,))

    def run(self, text: str, state: State = start) -> State:
        """The state behind text; its last count grows by the text's tokens."""
        at, last, count = state.node, list(state.last), list(state.count)
        moves, ends, pairs = self.moves, self.ends, self.pairs
        for c in text:
            node = moves[at].get(c)
            if node is None:
                node = self._move(at, c)
            if node < 0:
                at = 0
                last.append(START)
                count.append(count[-1] + len(c.encode("utf-8", "surrogatepass")))
                continue
            at = node
            for n, t in ends[node]:
                u = last[-n]
                stable = pairs.get(u << 20 | t)
                if stable is None:
                    stable = self._pair(u, t)
                if stable:
                    count.append(count[-n] + 1)
                    last.append(t)
                    break
        return State(at, tuple(last[-self.longest - 1 :]), tuple(count[-self.longest - 1 :]))

    def chunk(self, text: str) -> Map:
        """The map of any run of characters; constant behind the first two characters that no entry holds together."""
        at = next((i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.beside), 0)
        if not at:
            return Map(text, 0, None)
        end = self.run(text[at:])
        return Map(text[:at], end.count[-1], self._based(end))

    @staticmethod
    def _based(state: State) -> State:
        return State(state.node, state.last, tuple(x - state.count[-1] for x in state.count))

    def compose(self, a: Map, b: Map) -> Map:
        """First a, then b."""
        if a.exit is None:
            return Map(a.head + b.head, b.count, b.exit)
        end = self.run(b.head, a.exit)
        if b.exit is None:
            return Map(a.head, a.count + end.count[-1], self._based(end))
        return Map(a.head, a.count + end.count[-1] + b.count, b.exit)

    def scan(self, maps: list[Map]) -> Map:
        """Composition of all, in pairs."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def tokens(self, text: str) -> int:
        """Tokens of a run of characters from the start state, by the maps of its parts."""
        whole = self.scan([self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)])
        return self.run(whole.head).count[-1] + whole.count

    def _moves(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Nodes behind characters that entries have; new transitions are compiled."""
        keys = nodes.astype("i8") * len(self.characters) + codes + 1
        to = self.moved.get(keys)
        new = np.flatnonzero(to < 0)
        if len(new):
            distinct, which, where = np.unique(keys[new], return_index=True, return_inverse=True)
            made = np.array([self._move(n, chr(c)) for n, c in zip(nodes[new[which]].tolist(), codes[new[which]].tolist(), strict=True)], "i4")
            self.moved.put(distinct, made)
            to[new] = made[where]
        return to

    def _stable(self, before: np.ndarray, entries: np.ndarray) -> np.ndarray:
        keys = before.astype("i8") << 20 | entries
        found = self.stable.get(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, where = np.unique(keys[new], return_inverse=True)
            made = np.array([self._pair(k >> 20, k & 0xFFFFF) for k in distinct.tolist()], "i4")
            if self.stable.size < PAIRS:
                self.stable.put(distinct, made)
            found[new] = made[where]
        return found > 0

    def _lanes(self, chunks: list[str]) -> np.ndarray:
        """Tokens of chunks from the start state; the longest chunk comes first and the others in order."""
        sizes = np.fromiter(map(len, chunks), "i8", len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype("i4")
        first = np.cumsum(sizes) - sizes
        node = np.zeros(len(chunks), "i4")
        last, count = (np.zeros((int(sizes[0]) + 1, len(chunks)), "i4") for _ in range(2))
        for j, m in enumerate(np.searchsorted(-sizes, -np.arange(sizes[0])).tolist(), 1):
            c = codes[first[:m] + j - 1]
            known = self.characters[c] >= 0
            lanes = np.flatnonzero(known)
            if len(lanes) < m:  # characters without an entry are bytes
                node[:m][~known] = 0
                count[j, :m] = count[j - 1, :m] + 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            node[lanes] = self._moves(node[lanes], c[lanes])
            at = self.begins[node[lanes]]
            while len(lanes):
                n, t = self.end_size[at], self.end_entry[at]
                ok = self._stable(last[j - n, lanes], t)
                done = lanes[ok]
                last[j, done] = t[ok]
                count[j, done] = count[j - n[ok], done] + 1
                lanes, at = lanes[~ok], at[~ok] + 1
        return count[sizes, np.arange(len(chunks))]

    def chunk_counts(self, chunks: list[str]) -> np.ndarray:
        """Counts of the constant maps of chunks that begin with a word mark."""
        out = np.zeros(len(chunks), "i8")
        sizes = np.fromiter(map(len, chunks), "i8", len(chunks))
        for i in np.flatnonzero(sizes > CHUNK).tolist():
            out[i] = self.tokens(chunks[i])
        order = np.argsort(-sizes, kind="stable")
        order = order[np.count_nonzero(sizes > CHUNK) :]
        for a in range(0, len(order), LANES):
            own = order[a : a + LANES]
            out[own] = self._lanes([chunks[i] for i in own.tolist()])
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts, a word mark in front; meant for some MB at a time."""
        if not texts:
            return []
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), MARK, " "), " ")
        at = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words, where = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        n = self.chunk_counts([MARK + w for w in words])
        before = np.concatenate(([0], np.cumsum(n[where])))
        out = np.diff(before[at])
        # word marks in a row belong to the chunk that they begin
        empty = np.concatenate(([0], np.cumsum(where == words.index("")))) if "" in words else None
        odd = np.flatnonzero(np.diff(empty[at])).tolist() if empty is not None else []
        if odd:
            chunks = [re.findall(f"{MARK}+[^{MARK}]*", MARK + texts[i].replace(" ", MARK)) if texts[i] else [] for i in odd]
            number = {c: k for k, c in enumerate(dict.fromkeys(c for cs in chunks for c in cs))}
            n = self.chunk_counts(list(number))
            before = np.cumsum([0, *(n[number[c]] for cs in chunks for c in cs)])
            out[odd] = np.diff(before[np.cumsum([0, *map(len, chunks)])])
        return out.tolist()


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """The transducer of a sentencepiece byte-pair model with byte fallback; one per worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return Transducer({model.id_to_piece(i): model.get_score(i) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))})


def forget() -> None:
    compiled.cache_clear()
