"""Layout arithmetic on arrays and counts, as columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import draw, draw_rank


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), x worked out once however often f names it: Spark repeats a column within higher-order functions."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def loss_weight(n: Column, mode: str) -> Column:
    """Weight of each token of a sample with n of them; 0 for none."""
    x = n.cast("double")
    weights = {"token": F.lit(1.0), "sample": 1.0 / x, "square": 1.0 / F.sqrt(x)}
    if mode not in weights:
        raise ValueError(f"unknown weighting {mode}")
    return F.when(n == 0, F.lit(0.0)).otherwise(weights[mode])


def power_above(n: Column) -> Column:
    """The least power of two above n; 1 for n <= 0."""
    return F.when(n <= 0, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, 1)") * 0 + F.pow(F.lit(2.0), F.length(F.bin(n))).cast("long"))


def split_counts(n: Column, least: int = 16, most: int = 512) -> Column:
    """Powers of two K with n/K from least to most; a count over `most`/`least` bounds has several."""
    powers = F.array(*[F.lit(1 << k).cast("long") for k in range(40)])
    return F.when(n <= least, F.array(F.lit(1).cast("long"))).otherwise(F.filter(powers, lambda k: (k >= n.cast("double") / most) & (k <= n.cast("double") / least)))


def chosen_split(counts: Column, u: Column) -> Column:
    """One of counts by a draw: K has weight 1 / 2K, and the first whose summed weight exceeds the draw is taken."""
    weight = lambda k: 0.5 / k.cast("double")
    total = F.aggregate(counts, F.lit(0.0), lambda a, k: a + weight(k))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(counts, start, lambda a, k: F.struct((a["sum"] + weight(k)).alias("sum"), F.when((a["at"] == 0) & (u * total < a["sum"] + weight(k)), k).otherwise(a["at"]).alias("at")))["at"]


def chunks(n: Column, k: Column) -> Column:
    """n in k near-equal parts, what is over in the first."""
    part = F.floor(n / k).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.when(i == 0, n - part * (k - 1)).otherwise(part))


def transfer_counts(masked: Column, steps: int) -> Column:
    """How many of `masked` positions each of the steps reveals: equal parts, one more in the first of them."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: (F.floor(masked / steps) + (i < masked % steps).cast("long")).cast("long"))


def padded_length(n: Column) -> Column:
    """A length filled up: to the power of two above it, or three quarters of that if they hold it."""
    p = power_above(n)
    three = (p * 3 / 4).cast("long")
    return F.when(n.cast("double") > p.cast("double") * 0.75, p).otherwise(three)


def patchify(values: Column, channels: int, height: int, width: int, patch: int) -> Column:
    """[c, h, w] values as rows of patches; within a patch by row, column, channel."""
    if height % patch or width % patch:
        raise ValueError("sides must be multiples of the patch")
    order = [c * height * width + (i * patch + y) * width + j * patch + x for i in range(height // patch) for j in range(width // patch) for y in range(patch) for x in range(patch) for c in range(channels)]
    size = patch * patch * channels
    return F.array(*[F.array(*[F.get(values, F.lit(k)) for k in order[a : a + size]]) for a in range(0, len(order), size)])


def grid_ids(height: Column, width: Column, side: int) -> Column:
    """Flattened position ids of a grid of patches, row by row: row * side + column."""
    rows = F.sequence(F.lit(0).cast("long"), height - 1)
    return F.flatten(F.transform(rows, lambda i: F.transform(F.sequence(F.lit(0).cast("long"), width - 1), lambda j: i * side + j)))


def cut_at(ids: Column, end: int) -> Column:
    """ids up to the first `end`, which stays."""
    at = F.array_position(ids, F.lit(end))
    return F.when(at > 0, F.slice(ids, F.lit(1), at.cast("int"))).otherwise(ids)


def unpatchify(patches: Column, channels: int, height: int, width: int, patch: int) -> Column:
    """Rows of patches as [c, h, w] values again."""
    n = width // patch

    def at(c: int, y: int, x: int) -> Column:
        return F.get(F.get(patches, F.lit((y // patch) * n + x // patch)), F.lit(((y % patch) * patch + x % patch) * channels + c))

    return F.array(*[at(c, y, x) for c in range(channels) for y in range(height) for x in range(width)])


def pixel(x: Column) -> Column:
    """[-1, 1] to 0..255, cut off, not rounded."""
    return F.floor(F.greatest(F.least(x * 0.5 + 0.5, F.lit(1.0)), F.lit(0.0)) * 255).cast("int")


def _bucket(i: Column, n: Column, side: int) -> Column:
    """How many of the side's inner bounds are at or below i / n, both as 32-bit fractions: a guess, set right by its neighbours."""
    step = 1.0 / side
    bound = lambda k: (F.lit(step) + (k - 1) * step).cast("float")
    at = (i * (1.0 / n)).cast("float")
    guess = F.floor(at.cast("double") * side)
    return F.when((guess + 1 < side) & (bound(guess + 1) <= at), guess + 1).when((guess <= 0) | (bound(guess) <= at), guess).otherwise(guess - 1)


def interpolated_ids(height: Column, width: Column, side: int) -> Column:
    """Position ids of a grid of height x width patches, row by row, mapped onto a table of side x side; an empty grid has none."""
    ends = lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: _bucket(i, n, side))).otherwise(F.array().cast("array<bigint>"))
    # columns are worked out once, not once a row of the grid
    return once(ends(width), lambda xs: F.flatten(F.transform(ends(height), lambda y: F.transform(xs, lambda x: y * side + x))))


def composition(total: Column, decay: float, seed: int, *keys: Column | str) -> Column:
    """A random composition of total (1 or more): parts, and ends, their running sums from 0.

    The number of parts is uniform at decay 1, else geometric, cut off at total; places to cut at are the first by a draw each, in order.
    """
    total = total.cast("long")
    u = draw(seed, "composition/n", *keys)
    if decay == 1.0:
        n = 1 + F.floor(u * total)
    else:
        n = F.least(total, 1 + F.floor(F.log(1.0 - u * (1.0 - F.pow(F.lit(decay), total))) / math.log(decay)))
    places = F.when(total > 1, F.sequence(F.lit(1).cast("long"), total - 1)).otherwise(F.array().cast("array<bigint>"))
    drawn = F.slice(F.array_sort(F.transform(places, lambda i: F.struct(draw_rank(seed, "composition/cut", *keys, i).alias("u"), i.alias("i")))), F.lit(1), n.cast("int") - 1)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.array_sort(F.transform(drawn, lambda x: x["i"])), F.array(total))
    parts = lambda e: F.zip_with(F.slice(e, F.lit(2), F.size(e) - 1), F.slice(e, F.lit(1), F.size(e) - 1), lambda b, a: b - a)
    return once(ends, lambda e: F.struct(parts(e).alias("parts"), e.alias("ends")))


def cropped(values: Column, channels: int, height: int, width: int, to_height: int, to_width: int) -> Column:
    """The upper left corner of [c, h, w] values."""
    return F.array(*[F.get(values, F.lit((c * height + y) * width + x)) for c in range(channels) for y in range(to_height) for x in range(to_width)])


def unpacked(values: Column, lengths: Column, marks: int = 2) -> Column:
    """Rows of a pack given back to its samples, whose lengths count `marks` more."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("array()").cast("array<struct<at:bigint,n:bigint>>").alias("parts"))
    cut = F.aggregate(lengths, start, lambda a, n: F.struct((a["at"] + n - marks).cast("long").alias("at"), F.concat(a["parts"], F.array(F.struct(a["at"].alias("at"), (n - marks).cast("long").alias("n")))).alias("parts")))
    return F.transform(cut["parts"], lambda p: F.slice(values, (p["at"] + 1).cast("int"), p["n"].cast("int")))
