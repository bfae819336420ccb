"""Pixel transforms of image columns, against loops over pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillpack.functions import pixels as P

SCHEMA = f"k int, image {P.IMAGE}"


def pictures(c=3, sizes=((12, 10), (12, 10), (5, 9), (1, 1))):
    rng = np.random.default_rng(c)
    return [rng.integers(0, 256, (h, w, c), dtype=np.uint8) for h, w in sizes]


def frame(spark, images):
    return spark.createDataFrame([(i, None if x is None else (x.shape[2], x.shape[0], x.shape[1], x.tobytes())) for i, x in enumerate(images)], SCHEMA).repartition(2)


def out(df, column):
    rows = df.select("k", column.alias("o")).orderBy("k").collect()
    return [None if r["o"] is None else np.frombuffer(r["o"]["data"], np.uint8).reshape(r["o"]["h"], r["o"]["w"], r["o"]["c"]) for r in rows]


def same(got, want):
    return len(got) == len(want) and all((a is None and b is None) or (a is not None and b is not None and a.shape == b.shape and (a == b).all()) for a, b in zip(got, want, strict=True))


def slow_resize(image, width, height):
    """One pixel after the other, one side after the other."""

    def cubic(x):
        x = abs(x)
        return (1.5 * x - 2.5) * x * x + 1 if x < 1 else ((x - 5) * x + 8) * x * -0.5 + 2 if x < 2 else 0.0

    def line(values, m):
        n, made = len(values), []
        for i in range(m):
            scale = n / m
            wide, at = max(1.0, scale), (i + 0.5) * scale
            js = range(max(0, int(at - 2 * wide + 0.5)), min(n, int(at + 2 * wide + 0.5)))
            k = [cubic((j - at + 0.5) / wide) for j in js]
            whole = [int(x / sum(k) * 4194304 + (0.5 if x >= 0 else -0.5)) for x in k]
            made.append(min(255, max(0, (sum(int(values[j]) * a for j, a in zip(js, whole, strict=True)) + 2097152) >> 22)))
        return made

    h, w, c = image.shape
    wide = np.array([[line(image[y, :, k], width) for k in range(c)] for y in range(h)]).transpose(0, 2, 1)
    return np.array([[line(wide[:, x, k], height) for k in range(c)] for x in range(width)]).transpose(2, 0, 1).astype(np.uint8)


@pytest.mark.parametrize("size", [(10, 12), (4, 5), (23, 17), (1, 1), (0, 3)])
def test_resized(spark, size):
    images = pictures()
    got = out(frame(spark, [*images, None]), P.resized(F.col("image"), F.lit(size[0]), F.lit(size[1])))
    assert same(got, [*(slow_resize(x, *size) if min(size) else None for x in images), None])
    assert same(out(frame(spark, images[:1]), P.resized(F.col("image"), F.lit(10), F.lit(12))), images[:1])
    assert [x.shape for x in out(frame(spark, images), P.downscaled(F.col("image"), 0.5))] == [(6, 5, 3), (6, 5, 3), (2, 4, 3), (1, 1, 3)]


def test_channels(spark):
    one, three, four, two = (pictures(c)[0] for c in (1, 3, 4, 2))
    got = out(frame(spark, [one, three, four, two]), P.rgb(F.col("image")))
    over = np.rint((four[..., :3].astype(float) * four[..., 3:] + 255.0 * (255 - four[..., 3:])) / 255).astype(np.uint8)
    assert same(got, [np.repeat(one, 3, 2), three, over, None])
    luma = np.floor(three @ np.array([0.299, 0.587, 0.114]) + 0.5)
    grey = out(frame(spark, [one, three, two]), P.grey(F.col("image")))
    assert same(grey[:1], [one]) and grey[2] is None and abs(grey[1].astype(int) - luma[..., None].astype(int)).max() <= 1 and (grey[1] == grey[1][..., :1]).all()


def test_crops(spark):
    images = pictures()
    df = frame(spark, images).withColumn("box", P.crop_box(F.col("image"), 4, 6, 1, "k"))
    boxes = [r["box"] for r in df.orderBy("k").collect()]
    assert boxes[3] is None and all(b["right"] - b["left"] == 6 and b["bottom"] - b["top"] == 4 for b in boxes[:3])
    assert same(out(df, P.cropped(F.col("image"), F.col("box"))), [*(x[b["top"] : b["bottom"], b["left"] : b["right"]] for x, b in zip(images, boxes[:3], strict=False)), None])
    assert out(df, P.cropped(F.col("image"), F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(11).alias("right"), F.lit(1).alias("bottom")))) == [None] * 4


@pytest.mark.parametrize(("size", "angle"), [(1, 30), (5, 0), (5, 90), (6, 0), (7, 33), (15, 210)])
def test_motion_blur(spark, size, angle):
    images = pictures(sizes=((20, 19), (16, 17)))
    kernel = P.blur_kernel(size, angle)
    if angle == 0:
        assert (kernel[size // 2] == 1 / size).all() and kernel.sum() == pytest.approx(1)
    # the line keeps its middle and its direction
    y, x = np.mgrid[:size, :size] - (size / 2 - 0.5)
    off = abs(y * math.cos(math.radians(angle)) + x * math.sin(math.radians(angle)))
    assert kernel.min() >= 0 and kernel.sum() == pytest.approx(1) and (off[kernel > 1e-9] < 2).all()
    want = []
    for image in images:
        h, w, _ = image.shape
        mirror = lambda i, n: -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i
        made = np.zeros(image.shape)
        for r in range(h):
            for c in range(w):
                for dy in range(size):
                    for dx in range(size):
                        made[r, c] += kernel[dy, dx] * image[mirror(r + dy - size // 2, h), mirror(c + dx - size // 2, w)]
        want.append(made)
    got = out(frame(spark, images), P.motion_blur(F.col("image"), size, angle))
    assert all(abs(a - b).max() <= 0.5 + 1e-6 for a, b in zip(got, want, strict=True))


def test_patches(spark):
    images = pictures(sizes=((11, 10), (11, 10), (4, 4)))
    df = frame(spark, images).withColumn("o", P.patch_order(6, 3, "k"))
    orders = [r["o"] for r in df.orderBy("k").collect()]
    assert all(sorted(o) == list(range(6)) for o in orders) and len({tuple(o) for o in orders}) > 1
    want, blanks = [], []
    for x, o in zip(images, orders, strict=True):
        h, w, _ = x.shape
        y, z = [0, h // 3, h // 3 * 2, h], [0, w // 2, w]
        big, blank = np.full((h + 2 * 2, w + 2, 3), 255, np.uint8), x.copy()
        for p in range(6):
            cell = x[y[o[p] // 2] : y[o[p] // 2 + 1], z[o[p] % 2] : z[o[p] % 2 + 1]]
            for i in range(cell.shape[0]):
                for j in range(cell.shape[1]):
                    a, b = y[p // 2] + p // 2 * 2 + i, z[p % 2] + p % 2 * 2 + j
                    if a < big.shape[0] and b < big.shape[1]:
                        big[a, b] = cell[i, j]
        for c in o[:4]:
            blank[y[c // 2] : y[c // 2 + 1], z[c % 2] : z[c % 2 + 1]] = 255
        want.append(big)
        blanks.append(blank)
    assert same(out(df, P.shuffled_patches(F.col("image"), 3, 2, F.col("o"))), want)
    assert same(out(df, P.blanked_patches(F.col("image"), 3, 2, 0.7, F.col("o"))), blanks)
    assert P.patch_edges(11, 3) == [0, 3, 6, 11]


def test_preprocessed(spark):
    images = pictures()[:1]
    values = frame(spark, [*images, None]).orderBy("k").select(P.preprocessed(F.col("image"), 8).alias("v"), P.normalised(F.col("image")).alias("n")).collect()
    assert values[1]["v"] is None and len(values[0]["v"]) == 3 * 64
    assert values[0]["n"] == pytest.approx((images[0].astype("f4") / 255 * 2 - 1).transpose(2, 0, 1).ravel().tolist(), abs=1e-6)
    small = slow_resize(images[0], 8, 8)
    assert values[0]["v"] == pytest.approx((small / 255 * 2 - 1).transpose(2, 0, 1).ravel().tolist(), abs=1e-6)
