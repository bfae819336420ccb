"""Text functions of sample preparation, as columns. White space is ASCII white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0b]"
# The ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MASK_ID, IDS = 126336, 126000


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def blank(x: Column) -> Column:
    """True for null, empty, or white space only."""
    return F.coalesce(strip(x) == "", F.lit(True))


def without_image_tags(x: Column) -> Column:
    return strip(F.replace(x, F.lit("<image>"), F.lit("")))


def clean_response(x: Column) -> Column:
    """What follows the last </think>, without end marks, stripped."""
    return strip(F.replace(F.substring_index(x, "</think>", -1), F.lit("<|endoftext|>"), F.lit("")))


def remove_punctuation(x: Column) -> Column:
    return F.translate(x, PUNCTUATION, "")


def canonical(x: Column, keep: str | None = None) -> Column:
    """Without punctuation, except in the literal `keep`; runs of white space become one space; case stays."""
    if keep:
        from re import escape

        bare = F.array_join(F.transform(F.split(x, escape(keep), -1), remove_punctuation), keep)
    else:
        bare = remove_punctuation(x)
    return strip(F.regexp_replace(bare, f"{SPACE}+", " "))


def words(x: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(x, F.lit("")), f"{SPACE}+", -1), "")


def n_tokens(x: Column) -> Column:
    """Tokens of the default tokenizer, which is words()."""
    return F.size(words(x)).cast("long")


def token_id(word: Column) -> Column:
    """The default tokenizer's id of a word; below the mask id."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % IDS).cast("int")


def token_ids(x: Column) -> Column:
    return F.transform(words(x), token_id)


def wrapped(ids: Column, bos: int, eos: int) -> Column:
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def with_end(ids: Column, eos: int) -> Column:
    """eos behind, unless it is there."""
    return F.when(F.element_at(ids, -1) == eos, ids).otherwise(F.concat(ids, F.array(F.lit(eos))))


def padded_name(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")
