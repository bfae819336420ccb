"""Sizes of images and indices of frames, as columns; rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import once
from .draws import draw, draw_rank


def divisible(v: Column, stride: int) -> Column:
    """The nearest multiple of stride, at least one."""
    return F.greatest(F.lit(stride).cast("long"), (F.bround(v.cast("double") / stride) * stride).cast("long"))


def _scaled(w: Column, h: Column, k: Column, stride: int) -> tuple[Column, Column]:
    return divisible(F.bround(w.cast("double") * k), stride), divisible(F.bround(h.cast("double") * k), stride)


def resized(w: Column, h: Column, longest: int, shortest: int, stride: int, pixels: int, images: Column | int = 1) -> tuple[Column, Column]:
    """(width, height) behind a resize to at most `longest`, at least `shortest`, and a share of `pixels`.

    The area correction scales by the quotient of areas, not by its root, and the last step may undershoot `shortest`.
    """
    n = F.lit(images).cast("double") if isinstance(images, int) else images.cast("double")
    w, h = w.cast("double"), h.cast("double")
    k = F.greatest(F.least(longest / F.greatest(w, h), F.lit(1.0)), shortest / F.least(w, h))
    a, b = _scaled(w, h, k, stride)
    share = F.lit(float(pixels)) / n
    over = (a * b).cast("double") > share
    k2 = share / (a * b).cast("double")
    a2, b2 = _scaled(a, b, k2, stride)
    a, b = F.when(over, a2).otherwise(a), F.when(over, b2).otherwise(b)
    long_side = F.greatest(a, b)
    k3 = longest / long_side.cast("double")
    a3, b3 = _scaled(a, b, k3, stride)
    return F.when(long_side > longest, a3).otherwise(a), F.when(long_side > longest, b3).otherwise(b)


def patches(w: Column, h: Column, patch: int) -> Column:
    return (F.floor(h / patch) * F.floor(w / patch)).cast("long")


def _bounds(total: Column, n: Column) -> Column:
    """Integer ends of n equal intervals of 0..total."""
    return F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long")), lambda i: F.floor(i * total / n).cast("long"))


def frames_middle(total: Column, n: int) -> Column:
    """Indices of n frames from the middles of equal intervals; a shorter clip gives every frame and repeats its last one."""
    take = F.least(F.lit(n).cast("long"), total.cast("long"))
    ends = _bounds(total.cast("double"), take)
    mids = F.transform(F.sequence(F.lit(1).cast("int"), take.cast("int")), lambda i: F.floor((F.get(ends, i - 1) + F.get(ends, i) - 1) / 2).cast("long"))
    return F.concat(mids, F.array_repeat(F.element_at(mids, -1), (F.lit(n) - take).cast("int")))


def frames_rate(total: Column, native: Column, rate: float, most: int | None = None) -> Column:
    """Frames at centres of spans of 1 / rate seconds."""
    delta = 1.0 / rate
    seconds = total.cast("double") / native
    times = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(seconds / delta).cast("int") - 1, F.lit(0))), lambda i: i * delta + delta / 2)
    out = F.filter(F.transform(F.filter(times, lambda t: t < seconds + delta / 2), lambda t: F.bround(t * native).cast("long")), lambda i: i < total)
    return F.slice(out, 1, most) if most else out


def frames_drawn(total: Column, n: int, seed: int, *keys: Column | str) -> Column:
    """A frame of each of n equal intervals, its last frame excluded; if an interval is that short, a sorted draw without return."""
    total = total.cast("long")
    take = F.least(F.lit(n).cast("long"), total)
    end = lambda i: F.floor(i * total.cast("double") / take).cast("long")
    order = F.sequence(F.lit(1), take.cast("int"))
    # an interval's first frame, and how many there are in front of its last one
    spans = F.transform(order, lambda i: F.struct(i.alias("i"), end(i - 1).alias("low"), (end(i) - 1 - end(i - 1)).alias("room")))
    drawn = lambda s: F.transform(s, lambda x: (x["low"] + F.floor(draw(seed, "frame", *keys, x["i"]) * x["room"])).cast("long"))
    mixed = F.transform(F.sequence(F.lit(0).cast("long"), total - 1), lambda i: F.struct(draw_rank(seed, "shuffle", *keys, i).alias("u"), i.alias("i")))
    fallback = F.array_sort(F.transform(F.slice(F.array_sort(mixed), F.lit(1), take.cast("int")), lambda s: s["i"]))
    out = once(spans, lambda s: F.when(F.exists(s, lambda x: x["room"] <= 0), fallback).otherwise(drawn(s)))
    return once(out, lambda f: F.concat(f, F.array_repeat(F.element_at(f, -1), (F.lit(n) - take).cast("int"))))


def over_white(value: Column, alpha: Column) -> Column:
    """A channel laid over white by its alpha (0..1)."""
    return alpha * value + (1.0 - alpha) * 255.0


def frames_fixed(total: Column, n: int, place: int) -> Column:
    """The frame `place` behind the beginning of each of n equal intervals; a shorter clip repeats its last one."""
    take = F.least(F.lit(n).cast("long"), total.cast("long"))
    out = F.transform(F.slice(_bounds(total.cast("double"), take), F.lit(1), take.cast("int")), lambda low: low + place)
    return F.concat(out, F.array_repeat(F.element_at(out, -1), (F.lit(n) - take).cast("int")))


def frames_spaced(total: Column, n: int) -> Column:
    """n frames from the first to the last, evenly spaced, cut to whole numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (total - 1).cast("double") / max(n - 1, 1)).cast("long"))


def frames_stepped(total: Column, native: Column, rate: float) -> Column:
    """Every (native / rate)th frame in front of the last one, cut to whole numbers."""
    step = native.cast("double") / rate
    count = F.ceil((total - 1) / step).cast("int")
    return F.when(count < 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.floor(i * step).cast("long")))


def clip_length(start: Column, end: Column, native: Column) -> Column:
    """Frames of a clip given in seconds."""
    return F.floor((end - start) * native).cast("long")


def in_clip(frames: Column, start: Column, native: Column) -> Column:
    """Frames of a clip as frames of the whole video."""
    return F.transform(frames, lambda i: i + F.floor(start * native).cast("long"))


def frame_source(path: Column) -> Column:
    """What a path is read as: a folder of frames if it ends in a slash, else a video."""
    return F.when(path.endswith("/"), "folder").otherwise("video")
