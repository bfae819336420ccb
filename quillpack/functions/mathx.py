"""Schedules, noise and guidance arithmetic, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def shifted(t: Column, shift: float) -> Column:
    return shift * t / (1.0 + (shift - 1.0) * t)


def grid(points: int, shift: float) -> list[float]:
    """Timesteps from 1 to 0, shifted."""
    steps = [1.0 - k / (points - 1) for k in range(points)]
    return [shift * t / (1.0 + (shift - 1.0) * t) for t in steps]


def flow_mix(x: Column, noise: Column, t: Column) -> Column:
    return F.zip_with(x, noise, lambda a, b: (1.0 - t) * a + t * b)


def flow_target(x: Column, noise: Column) -> Column:
    return F.zip_with(x, noise, lambda a, b: b - a)


def euler(x: Column, v: Column, dt: Column) -> Column:
    return F.zip_with(x, v, lambda a, b: a - b * dt)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double")))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, a: s + a)


def guided(conditional: Column, other: Column, scale: Column) -> Column:
    """other + scale * (conditional - other)"""
    return F.zip_with(conditional, other, lambda v, u: u.cast("double") + scale * (v.cast("double") - u.cast("double")))


def renormalised(conditional: Column, combined: Column, least: float = 0.0) -> Column:
    """combined, shrunk to the conditional's norm; never stretched, never by more than to `least`."""
    k = F.least(F.greatest(norm(conditional) / (norm(combined) + 1e-8), F.lit(least)), F.lit(1.0))
    return F.transform(combined, lambda x: x * k)


def gated(t: Column, low: float, high: float, scale: float) -> Column:
    """The guidance scale while low < t <= high, else 1."""
    return F.when((t > low) & (t <= high), F.lit(scale)).otherwise(F.lit(1.0))


def gumbel(logit: Column, u: Column, temperature: float) -> Column:
    """What the greatest of is a sample; the logit itself at temperature 0."""
    return logit if temperature == 0 else F.exp(logit) / F.pow(-F.log(u), F.lit(temperature))


def moving_average(old: Column, new: Column, decay: float) -> Column:
    return old * decay + new * (1.0 - decay)


def rms_normalised(x: Column, eps: float = 1e-5) -> Column:
    mean = F.aggregate(x, F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double")) / F.size(x)
    return F.transform(x, lambda a: a.cast("double") / F.sqrt(mean + eps))


def frequency(i: Column, width: int, base: float = 10000.0) -> Column:
    return F.pow(F.lit(base), -(2.0 * i / width))


def timestep_embedding(t: Column, width: int, longest: float = 10000.0) -> Column:
    """cos half, sin half; an odd width ends in a zero."""
    half = width // 2
    args = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: t * F.exp(-math.log(longest) * i / half))
    out = F.concat(F.transform(args, F.cos), F.transform(args, F.sin))
    return F.concat(out, F.array(F.lit(0.0))) if width % 2 else out


def learning_rate(step: Column, top: float, warm: int, total: int, least: float = 0.0, kind: str = "constant") -> Column:
    """Linear warm-up, then constant, or a cosine down to `least`."""
    rise = top * step / max(warm, 1)
    if kind == "constant":
        return F.when(step < warm, rise).otherwise(F.lit(top))
    if kind != "cosine":
        raise ValueError(f"unknown schedule {kind}")
    part = (step - warm) / max(total - warm, 1)
    return F.when(step < warm, rise).otherwise(least + (top - least) * F.greatest(F.lit(0.0), 0.5 * (1.0 + F.cos(math.pi * part))))


def rotary_angles(pos: Column, width: int, base: float = 10000.0, factor: float = 1.0, longest: int | None = None, length: int | None = None) -> Column:
    """pos / base^(2i / width) for half the width. factor stretches positions; with longest, a length beyond it raises the base instead."""
    if longest and length and length > longest:
        base, factor = base * ((factor * length / longest) - (factor - 1)) ** (width / (width - 2)), 1.0
    return F.transform(F.sequence(F.lit(0), F.lit(width // 2 - 1)), lambda i: pos / factor / F.pow(F.lit(base), 2.0 * i / width))


def rotated_half(x: Column) -> Column:
    """The second half, negated, in front of the first."""
    half = F.floor(F.size(x) / 2).cast("int")
    return F.concat(F.transform(F.slice(x, half + 1, half), lambda v: -v), F.slice(x, F.lit(1), half))


def rotated(x: Column, angles: Column) -> Column:
    both = F.concat(angles, angles)
    return F.zip_with(F.zip_with(x, both, lambda v, a: v * F.cos(a)), F.zip_with(rotated_half(x), both, lambda v, a: v * F.sin(a)), lambda a, b: a + b)


def rotated_2d(x: Column, row: Column, col: Column, base: float = 10000.0) -> Column:
    """A vector whose first half is turned by its patch's row, the second by its column."""
    width = F.size(x)
    half = F.floor(width / 2).cast("int")
    angle = lambda p: F.transform(F.sequence(F.lit(0), F.floor(half / 2).cast("int") - 1), lambda i: p / F.pow(F.lit(base), 2.0 * i / half))
    return F.concat(rotated(F.slice(x, F.lit(1), half), angle(row)), rotated(F.slice(x, half + 1, half), angle(col)))


def latent(z: Column, scale: float = 0.3611, shift: float = 0.1159) -> Column:
    return scale * (z - shift)


def from_latent(z: Column, scale: float = 0.3611, shift: float = 0.1159) -> Column:
    return z / scale + shift


def sampled_latent(mean: Column, logvar: Column, noise: Column) -> Column:
    return mean + F.exp(0.5 * logvar) * noise


def worker_seed(seed: int, world: int, rank: Column) -> Column:
    return F.lit(seed) * world + rank


def table_2d(pos_h: Column, pos_w: Column, width: int) -> Column:
    """Sine and cosine of both axes; the first half encodes the column."""
    one = lambda p: F.concat(F.transform(F.sequence(F.lit(0), F.lit(width // 4 - 1)), lambda i: F.sin(p * frequency(i, width // 2))), F.transform(F.sequence(F.lit(0), F.lit(width // 4 - 1)), lambda i: F.cos(p * frequency(i, width // 2))))
    return F.concat(one(pos_w), one(pos_h))


def shrinking(conditional: Column, combined: Column, least: float = 0.0) -> Column:
    """What a vector of norm `combined` is multiplied by to have the conditional's norm: at most 1, at least `least`."""
    return F.least(F.greatest(conditional / (combined + 1e-8), F.lit(least)), F.lit(1.0))


def guided_by_both(conditional: Column, without_text: Column, without_image: Column, text_scale: float, image_scale: float, kind: str, least: float = 0.0, norms: tuple[Column, Column] | None = None) -> Column:
    """Guidance by text, and by image if its scale is over 1, renormalised.

    channel: the outcome, by its own norm; text_channel: behind the text step, which image guidance follows; global: the outcome by norms over all
    of a sample, given as (conditional, combined). The conditional is returned where the text scale isn't over 1.
    """
    if text_scale <= 1.0:
        return conditional
    by_text = guided(conditional, without_text, F.lit(text_scale))
    if kind == "text_channel":
        by_text = renormalised(conditional, by_text, least)
    out = guided(by_text, without_image, F.lit(image_scale)) if image_scale > 1.0 else by_text
    if kind == "text_channel":
        return out
    if kind == "channel":
        return renormalised(conditional, out, least)
    if kind != "global" or norms is None:
        raise ValueError(f"{kind} is not supported, or norms are missing")
    k = shrinking(*norms, least)
    return F.transform(out, lambda x: x * k)


def unit(x: Column) -> Column:
    """x by its norm."""
    n = norm(x)
    return F.transform(x, lambda a: a.cast("double") / n)
