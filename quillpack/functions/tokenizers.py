"""Pluggable tokenizers: a protocol, the special tokens, and a wrapper that runs one in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Special tokens that are added where the vocabulary lacks them.
SPECIAL = ("<|startoftext|>", "<|endoftext|>", "<|vision_start|>", "<|vision_end|>")


class Tokenizer(Protocol):
    def encode(self, texts: list[str]) -> list[list[int]]: ...


def special_ids(vocabulary: dict[str, int]) -> tuple[dict[str, int], int]:
    """Ids of the special tokens, and how many were added behind the vocabulary's greatest id."""
    out, n = {}, max(vocabulary.values(), default=-1) + 1
    added = 0
    for t in SPECIAL:
        if t in vocabulary:
            out[t] = vocabulary[t]
        else:
            out[t] = n + added
            added += 1
    return out, added


def encoder(make: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """A column function that encodes texts with the tokenizer that make() gives, made once per worker."""
    held: list[Tokenizer] = []

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(make())
        return pd.Series(held[0].encode(texts.fillna("").tolist()))

    return ids


def sentencepiece(path: str) -> Callable[[], Tokenizer]:
    """A sentencepiece model that doesn't put a mark in front of a text that continues a word."""

    class Model:
        def __init__(self) -> None:
            import sentencepiece as sp

            self.model = sp.SentencePieceProcessor(model_file=path)
            self.skip = len(self.model.encode("<unk>", out_type=str))

        def encode(self, texts: list[str]) -> list[list[int]]:
            return [x[self.skip :] for x in self.model.encode(["<unk>" + t for t in texts])]

    return Model


def joined(tokens: list[str], special: set[str]) -> str:
    """Pieces as text again; a space in front of a special token that doesn't follow one."""
    out, last = "", False
    for t in tokens:
        if t in special:
            out += ("" if last or not out else " ") + t
            last = True
        else:
            out += t.replace("▁", " ")
            last = False
    return out.strip()


def special_mask(first: Column, second: Column | None = None) -> Column:
    """0 for every token and 1 for the end mark of each of one or two texts."""
    one = F.concat(F.array_repeat(F.lit(0), F.size(first)), F.array(F.lit(1)))
    return one if second is None else F.concat(one, F.array_repeat(F.lit(0), F.size(second)), F.array(F.lit(1)))
