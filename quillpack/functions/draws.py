"""Reproducible draws: a number in [0, 1) for a seed, a purpose and a row's keys, as a column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def draw(seed: int, purpose: str, *keys: Column | str | int) -> Column:
    """Uniform on [0, 1): the first 32 bits of an MD5 of seed, purpose and keys. Equal keys draw alike."""
    return F.conv(draw_rank(seed, purpose, *keys), 16, 10).cast("double") / F.lit(4294967296.0)


def draw_rank(seed: int, purpose: str, *keys: Column | str | int) -> Column:
    """Eight hex digits that sort as draw() does: enough where only the order of draws counts."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *(_col(k).cast("string") for k in keys))
    return F.substring(F.md5(text), 1, 8)


def draw_int(low: Column | int, high: Column | int, seed: int, purpose: str, *keys: Column | str | int) -> Column:
    """Uniform on the integers low..high."""
    low, high = _col(low), _col(high)
    return (low + F.floor(draw(seed, purpose, *keys) * (high - low + 1))).cast("long")


def draw_normal(seed: int, purpose: str, *keys: Column | str | int) -> Column:
    """Standard normal, from two uniform draws."""
    a, b = 1.0 - draw(seed, purpose + "/a", *keys), draw(seed, purpose + "/b", *keys)
    return F.sqrt(-2.0 * F.log(a)) * F.cos(2.0 * math.pi * b)


def duck_draw(seed: int, purpose: str, *keys: str) -> str:
    """draw() for DuckDB."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{purpose}', {', '.join(f'({k})::VARCHAR' for k in keys)})), 1, 8))::BIGINT / 4294967296.0)"
