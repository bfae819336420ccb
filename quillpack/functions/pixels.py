"""Pixel transforms of image columns (c, h, w, data: bytes row by row, the channels of a pixel together).

Each is a pandas UDF that stacks the images of a batch that have one shape and works on all of them at once. What a transform draws, an order of patches or
a place to cut at, is drawn outside, by keyed draws, and handed in as a column. A null image gives null, and so does one that a transform can't take.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .draws import draw, draw_int

IMAGE = "struct<c:int,h:int,w:int,data:binary>"
#: Bits of the weights of a resize, and of the shares of red, green and blue in a grey.
WEIGHT_BITS, GREY_BITS, GREY = 22, 16, (19595, 38470, 7471)
WHITE = 255


def _stacked(images: pd.DataFrame, args: list[pd.Series], f: Callable) -> pd.DataFrame:
    """f(images [n, h, w, c], *one set of arguments) for rows that have shape and arguments in common; None: no image."""
    out: list = [None] * len(images)
    rows: dict = {}
    plain = [[tuple(v) if isinstance(v, (list, np.ndarray)) else v for v in a] for a in args]
    for i, (c, h, w, data, *own) in enumerate(zip(images["c"], images["h"], images["w"], images["data"], *plain, strict=True)):
        # a null image comes as nulls
        if data is not None and not any(v is None or v != v for v in (c, h, w, *own)) and len(data) == int(c) * int(h) * int(w) > 0:
            rows.setdefault((int(c), int(h), int(w), *own), []).append(i)
    for (c, h, w, *own), at in rows.items():
        done = f(np.stack([np.frombuffer(images["data"].iloc[i], np.uint8).reshape(h, w, c) for i in at]), *own)
        if done is not None:
            for i, x in zip(at, done, strict=True):
                out[i] = (x.shape[2], x.shape[0], x.shape[1], np.ascontiguousarray(x).tobytes())
    return pd.DataFrame([x if x is not None else (None, None, None, None) for x in out], columns=["c", "h", "w", "data"]).astype({k: "Int32" for k in "chw"})


def _column(f: Callable, image: Column, *args: Column) -> Column:
    if not args:

        @pandas_udf(IMAGE)
        def run(images: pd.DataFrame) -> pd.DataFrame:
            return _stacked(images, [], f)

    elif len(args) == 1:

        @pandas_udf(IMAGE)
        def run(images: pd.DataFrame, a: pd.Series) -> pd.DataFrame:
            return _stacked(images, [a], f)

    else:

        @pandas_udf(IMAGE)
        def run(images: pd.DataFrame, a: pd.Series, b: pd.Series) -> pd.DataFrame:
            return _stacked(images, [a, b], f)

    made = run(image, *args)
    return F.when(made["data"].isNotNull(), made)


@lru_cache(maxsize=512)
def weights(n: int, m: int) -> np.ndarray:
    """[m, n]: what each of n pixels counts for in each of m, by a cubic that is widened where it shrinks; whole numbers, 2 ** WEIGHT_BITS in all."""
    scale = n / m
    wide = max(scale, 1.0)
    out = np.zeros((m, n))
    for i in range(m):
        at = (i + 0.5) * scale
        lo, hi = max(0, int(at - 2 * wide + 0.5)), min(n, int(at + 2 * wide + 0.5))
        x = np.abs((np.arange(lo, hi) - at + 0.5) / wide)
        k = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((x - 5) * x + 8) * x * -0.5 + 2, 0))
        out[i, lo:hi] = k / k.sum()
    return np.trunc(out * (1 << WEIGHT_BITS) + np.copysign(0.5, out)).astype("i8")


def _resized(images: np.ndarray, width: int, height: int) -> np.ndarray | None:
    """Along rows, then along columns, rounded to bytes after each."""
    if width < 1 or height < 1:
        return None
    half = 1 << (WEIGHT_BITS - 1)
    out = np.einsum("nywc,xw->nyxc", images.astype("i8"), weights(images.shape[2], int(width)))
    out = np.clip((out + half) >> WEIGHT_BITS, 0, 255)
    out = np.einsum("nhxc,yh->nyxc", out, weights(images.shape[1], int(height)))
    return np.clip((out + half) >> WEIGHT_BITS, 0, 255).astype(np.uint8)


def resized(image: Column, width: Column, height: Column) -> Column:
    """Antialiased bicubic; null where a side would be empty."""
    return _column(_resized, image, width.cast("int"), height.cast("int"))


def downscaled(image: Column, factor: float) -> Column:
    """Both sides times a factor, rounded half to even, one pixel at least."""
    side = lambda s: F.greatest(F.lit(1), F.bround(image[s] * F.lit(factor)).cast("int"))
    return resized(image, side("w"), side("h"))


def _rgb(images: np.ndarray) -> np.ndarray | None:
    c = images.shape[3]
    if c == 1:
        return np.repeat(images, 3, 3)
    if c == 4:
        a = images[..., 3:].astype("i4")
        t = images[..., :3] * a + WHITE * (255 - a) + 128
        return ((t + (t >> 8)) >> 8).astype(np.uint8)
    return images if c == 3 else None


def rgb(image: Column) -> Column:
    """Three channels: one is repeated, a fourth is laid over white; null for another number."""
    return _column(_rgb, image)


def _grey(images: np.ndarray) -> np.ndarray | None:
    if images.shape[3] == 1:
        return images
    if images.shape[3] != 3:
        return None
    y = (images.astype("i8") @ np.array(GREY) + (1 << (GREY_BITS - 1))) >> GREY_BITS
    return np.repeat(y[..., None].astype(np.uint8), 3, 3)


def grey(image: Column) -> Column:
    """Luma on all three channels; an image of one channel stays."""
    return _column(_grey, image)


def _cut(images: np.ndarray, box: tuple) -> np.ndarray | None:
    x, y, w, h = map(int, box)
    return images[:, y : y + h, x : x + w] if 0 <= x and 0 <= y and 0 < w <= images.shape[2] - x and 0 < h <= images.shape[1] - y else None


def crop_box(image: Column, height: int, width: int, seed: int, *keys: Column | str) -> Column:
    """left, top, right, bottom of a drawn box of that size; null where the image is smaller."""
    left, top = draw_int(F.lit(0), image["w"] - width, seed, "crop/x", *keys), draw_int(F.lit(0), image["h"] - height, seed, "crop/y", *keys)
    fits = (image["w"] >= width) & (image["h"] >= height)
    return F.when(fits, F.struct(left.alias("left"), top.alias("top"), (left + width).alias("right"), (top + height).alias("bottom")))


def cropped(image: Column, box: Column) -> Column:
    """What lies in a box (left, top, right, bottom); null where that isn't all in the image."""
    return _column(_cut, image, F.when(box.isNotNull(), F.array(box["left"], box["top"], box["right"] - box["left"], box["bottom"] - box["top"])))


@lru_cache(maxsize=512)
def blur_kernel(size: int, angle: float) -> np.ndarray:
    """A horizontal line through the middle of size x size, turned by an angle in degrees around it, between pixels by their four neighbours; it sums up to 1."""
    c, s, mid = math.cos(math.radians(angle)), math.sin(math.radians(angle)), size / 2 - 0.5
    y, x = np.mgrid[:size, :size] - mid
    # where each place comes from
    from_x, from_y = c * x - s * y + mid, s * x + c * y + mid
    line = np.zeros((size + 2, size + 2))
    line[size // 2 + 1, 1:-1] = 1
    x0, y0 = np.floor(from_x).astype(int), np.floor(from_y).astype(int)
    fx, fy = from_x - x0, from_y - y0
    at = lambda dy, dx: line[np.clip(y0 + dy + 1, 0, size + 1), np.clip(x0 + dx + 1, 0, size + 1)]
    k = at(0, 0) * (1 - fx) * (1 - fy) + at(0, 1) * fx * (1 - fy) + at(1, 0) * (1 - fx) * fy + at(1, 1) * fx * fy
    return k / (k.sum() or 1.0)


def motion_blur(image: Column, size: int, angle: float) -> Column:
    """Every channel under a turned line; edges are reflected, the outermost pixels with them."""

    def blurred(images: np.ndarray) -> np.ndarray:
        kernel, before = blur_kernel(size, angle), size // 2
        big = np.pad(images.astype("f8"), ((0, 0), (before, size - 1 - before), (before, size - 1 - before), (0, 0)), "symmetric")
        h, w = images.shape[1:3]
        out = np.zeros(images.shape)
        for y, x in zip(*np.nonzero(kernel), strict=True):
            out += kernel[y, x] * big[:, y : y + h, x : x + w]
        return np.clip(np.round(out), 0, 255).astype(np.uint8)

    return _column(blurred, image)


def patch_edges(size: int, n: int) -> list[int]:
    """Ends of n equal cuts of a side; the last one takes the rest."""
    return [size // n * k for k in range(n)] + [size]


def _cells(height: int, width: int, rows: int, cols: int) -> list[tuple[slice, slice]]:
    y, x = patch_edges(height, rows), patch_edges(width, cols)
    return [(slice(y[i], y[i + 1]), slice(x[j], x[j + 1])) for i in range(rows) for j in range(cols)]


def patch_order(n: int, seed: int, *keys: Column | str) -> Column:
    """The numbers below n in a drawn order."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(draw(seed, "patches", *keys, i).alias("u"), i.alias("i")))
    return F.transform(F.array_sort(drawn), lambda x: x["i"])


def shuffled_patches(image: Column, rows: int, cols: int, order: Column, gap: int = 2) -> Column:
    """rows x cols cells, place by place those that `order` says, on white with a gap between places.

    Places have the sizes of the image's own cells. A cell that is smaller leaves white, one that is larger reaches into the gap and is covered by what comes
    later there, or cut off at the edge.
    """

    def mosaic(images: np.ndarray, chosen: tuple) -> np.ndarray:
        n, h, w, c = images.shape
        cells = _cells(h, w, rows, cols)
        out = np.full((n, h + (rows - 1) * gap, w + (cols - 1) * gap, c), WHITE, np.uint8)
        for p, (y, x) in enumerate(cells):
            top, left = y.start + p // cols * gap, x.start + p % cols * gap
            src = images[(slice(None), *cells[int(chosen[p])])][:, : out.shape[1] - top, : out.shape[2] - left]
            out[:, top : top + src.shape[1], left : left + src.shape[2]] = src
        return out

    return _column(mosaic, image, order)


def blanked_patches(image: Column, rows: int, cols: int, ratio: float, order: Column) -> Column:
    """Of rows x cols cells the first int(cells * ratio) of `order` are white."""
    count = max(0, min(int(rows * cols * ratio), rows * cols))

    def blanked(images: np.ndarray, chosen: tuple) -> np.ndarray:
        out, cells = images.copy(), _cells(*images.shape[1:3], rows, cols)
        for k in chosen[:count]:
            out[(slice(None), *cells[int(k)])] = WHITE
        return out

    return _column(blanked, image, order)


def normalised(image: Column, mean: float = 0.5, std: float = 0.5) -> Column:
    """Channel by channel, 0..255 to (x / 255 - mean) / std, as an array of floats."""

    @pandas_udf("array<float>")
    def run(images: pd.DataFrame) -> pd.Series:
        out = []
        for c, h, w, data in images[["c", "h", "w", "data"]].itertuples(index=False):
            out.append(None if data is None else ((np.frombuffer(data, np.uint8).astype("f4").reshape(int(h), int(w), int(c)) / 255 - np.float32(mean)) / np.float32(std)).transpose(2, 0, 1).ravel())
        return pd.Series(out)

    return run(image)


def preprocessed(image: Column, side: int = 224) -> Column:
    """Three channels, a square, normalised."""
    return normalised(resized(rgb(image), F.lit(side), F.lit(side)))


def image_of(values: Column, channels: int, height: int, width: int) -> Column:
    """An image of an array of 0..255, pixel by pixel."""
    data = F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))
    return F.struct(F.lit(channels).alias("c"), F.lit(height).alias("h"), F.lit(width).alias("w"), data.alias("data"))
