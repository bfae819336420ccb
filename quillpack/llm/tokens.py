"""Byte-level BPE ids of whole texts, every distinct word encoded once a slice.

The tokenizer's pattern never lets a token reach over a single space that has non-space characters on both sides, so
a text falls apart there, and each such word has ids of its own, whatever stands around it. Arrow splits a slice of
texts and numbers its distinct words; those that the worker doesn't remember are put together, spaces between, and given to the
library at once. No token but a word's first begins with a space, which tells whose the ids are, and the ids of texts
are gathered by numpy. Texts in which a space touches other white space or an end, or that hold a special string, go to the library whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back, slices

#: Words that a worker remembers: those met first, the frequent ones among them. Others are encoded anew in each slice.
WORDS = 600_000
#: Of those, what encoded() remembers: a slice takes memory for each of them, as for each of its own words.
HELD = 200_000
#: Characters of texts that are encoded at a time.
ENCODED = 2 << 20
#: Words in one text that the library is given, and texts in a call.
JOINED, CALL = 64, 256
#: White space to some libraries.
NO_SPACE = "\u180e"


def flat_ids(parts: list[array]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "u4")


class PieceEncoder:
    def __init__(self, path: str, words: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for x, i in vocabulary.items() if x.startswith("Ġ")]] = True
        self.most = words
        #: Words, and behind a row 0 for words that can't stand alone, where their ids are in flat.
        self.known = pa.array([], pa.large_string())
        self.begins, self.sizes, self.flat = np.zeros(1, "i4"), np.zeros(1, "i4"), np.zeros(0, "u4")

    def _ids(self, texts: list[str]) -> list[array]:
        """Few texts at a time: what the library returns takes many bytes a token."""
        return [array("I", e.ids) for i in range(0, len(texts), CALL) for e in self.library.encode_batch_fast(texts[i : i + CALL], add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many of each word) of words that stand behind a space."""
        joined = [" " + " ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        flat = flat_ids(self._ids(joined))
        begins = np.flatnonzero(self.opens[flat])
        if len(begins) != len(words):
            raise ValueError("the vocabulary has a token that reaches over the beginning of a word")
        return flat, np.diff(np.r_[begins, len(flat)])

    def _standing(self, words: list[str], texts: list[str]) -> np.ndarray:
        """Which words can stand alone."""
        rare = [x for x in (*self.special, NO_SPACE) if any(x in t for t in texts)]
        if rare:
            return np.array([bool(w) and w.strip() == w and not any(x in w for x in rare) for w in words], bool)
        return np.array([w.isalpha() or (w.strip() == w and w != "") for w in words], bool)

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many of each text); end: an id behind each text. Meant for some MB at a time."""
        if not texts:
            return np.zeros(0, "u4"), np.zeros(0, "i8")
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        where = coded.indices.to_numpy()
        row = pc.index_in(coded.dictionary, value_set=self.known).fill_null(-2).to_numpy() + np.int32(1)
        new = np.flatnonzero(row < 0)
        fresh = coded.dictionary.take(new).to_numpy(zero_copy_only=False).tolist()
        stands = self._standing(fresh, texts)
        flat, sizes = self._spaced([w for w, x in zip(fresh, stands.tolist(), strict=True) if x])
        # rows behind the remembered ones; those that are to be remembered come first
        row[new[~stands]] = 0
        row[new[stands]] = np.arange(len(sizes)) + len(self.begins)
        begins = np.r_[self.begins, (len(self.flat) + np.cumsum(sizes) - sizes).astype("i4")]
        sizes = np.r_[self.sizes, sizes.astype("i4")]
        flat = np.concatenate([self.flat, flat])
        first_words = at[:-1]
        odd = np.add.reduceat((row == 0)[where], first_words) > 0
        counts, source = sizes[row][where], begins[row][where]
        keep = min(len(sizes) - len(self.sizes), max(0, self.most - len(self.known)))
        if keep:
            rows = len(self.begins) + keep
            self.known = pa.concat_arrays([self.known, coded.dictionary.take(new[stands][:keep])])
            self.begins, self.sizes, self.flat = begins[:rows], sizes[:rows], flat[: int(begins[rows - 1] + sizes[rows - 1])]
        # a text's first word has no space in front; an odd text's ids are put in the place of its first word
        first = coded.dictionary.take(where[first_words]).to_pylist()
        heads = self._ids([t if o else w for w, t, o in zip(first, texts, odd.tolist(), strict=True)])
        if odd.any():
            counts[np.repeat(odd, np.diff(at))] = 0
        counts[first_words] = list(map(len, heads))
        source[first_words] = len(flat) + np.cumsum(counts[first_words]) - counts[first_words]
        lengths = np.add.reduceat(counts, first_words)
        if end is not None:
            counts, source = np.insert(counts, at[1:], 1), np.insert(source, at[1:], len(flat) + sum(map(len, heads)))
            lengths += 1
        counts, shift = counts.astype("i4"), (source - (np.cumsum(counts) - counts)).astype("i4")
        del where, row, fresh, coded, lists
        pool = np.concatenate([flat, flat_ids(heads), [np.uint32(end or 0)]])
        place = np.repeat(shift, counts)
        place += np.arange(len(place), dtype="i4")
        return pool[place], lengths.astype("i8")


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per file and worker process."""
    return PieceEncoder(path, HELD)


def encoded(batch: pa.RecordBatch, path: str, end: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, ids, how many of each text) of a batch's texts, slice by slice; what one took is given back before the next."""
    for a, texts in slices(batch, limit=ENCODED):
        flat, counts = encoder(path).encode(texts, end)
        give_back()
        yield a, len(texts), flat, counts


def forget() -> None:
    encoder.cache_clear()
