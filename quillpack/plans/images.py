"""Pixel transforms over images made of embeddings: 7 x 6 pixels of three channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..functions.draws import duck_draw
from .registry import query, table

H, W = 6, 7
#: Pixels of all images: y, x, c, v.
PX = f"""px AS (SELECT vec_id, i // {3 * W} AS y, i // 3 % {W} AS x, i % 3 AS c, ((vec_id * 31 + i * 17 + floor(abs(embedding[i % len(embedding) + 1]::DOUBLE) * 1000)::BIGINT) % 256)::BIGINT AS v
    FROM (SELECT vec_id, embedding, unnest(range({3 * W * H})) AS i FROM embeddings))"""
DIGEST = "md5(string_agg(printf('%02X', v), '' ORDER BY y, x, c)) AS digest"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    value = lambda i: (F.col("vec_id") * 31 + i * 17 + F.floor(F.abs(F.get(e, i % F.size(e)).cast("double")) * 1000)) % 256
    values = F.transform(F.sequence(F.lit(0), F.lit(3 * W * H - 1)), value)
    return table(spark, sf_dir, "embeddings").select("vec_id", P.image_of(values, 3, H, W).alias("image"))


def _digest(image: Column) -> Column:
    return F.md5(F.hex(image["data"]).cast("string")).alias("digest")


def _weights(n: int, m: int) -> str:
    """i, j, k: what pixel j counts for in pixel i, in whole numbers."""
    wide = max(n / m, 1.0)
    x = f"abs((j - mid + 0.5::DOUBLE) / {wide!r}::DOUBLE)"
    return f"""(SELECT i, j, trunc(k * {1 << P.WEIGHT_BITS} + CASE WHEN k < 0 THEN -0.5 ELSE 0.5 END)::BIGINT AS k FROM (SELECT i, j, f / sum(f) OVER (PARTITION BY i) AS k FROM (
        SELECT i, j, CASE WHEN {x} < 1 THEN (1.5 * {x} - 2.5) * {x} * {x} + 1 WHEN {x} < 2 THEN (({x} - 5) * {x} + 8) * {x} * -0.5 + 2 ELSE 0 END::DOUBLE AS f
        FROM (SELECT i, (i + 0.5::DOUBLE) * {n / m!r}::DOUBLE AS mid FROM range({m}) AS a(i)), range({n}) AS b(j) WHERE j >= trunc(greatest(mid - {2 * wide!r} + 0.5, 0)) AND j < trunc(mid + {2 * wide!r} + 0.5))))"""


def _round(x: str) -> str:
    return f"least(255, greatest(0, ({x} + {1 << (P.WEIGHT_BITS - 1)})::BIGINT >> {P.WEIGHT_BITS}))"


def resized_sql(w: int, h: int, source: str = "px") -> str:
    return f"""hor AS (SELECT vec_id, y, i AS x, c, {_round("sum(v * k)")} AS v FROM {source} JOIN {_weights(W, w)} ON j = x GROUP BY vec_id, y, i, c),
    ver AS (SELECT vec_id, i AS y, x, c, {_round("sum(v * k)")} AS v FROM hor JOIN {_weights(H, h)} ON j = y GROUP BY vec_id, i, x, c)"""


@query(f"WITH {PX}, {resized_sql(4, 9)} SELECT vec_id, {DIGEST} FROM ver GROUP BY vec_id")
def image_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrower and higher."""
    return _images(spark, sf_dir).select("vec_id", _digest(P.resized(F.col("image"), F.lit(4), F.lit(9))))


@query(f"WITH {PX}, {resized_sql(4, 3)} SELECT vec_id, sum(v * (c * 12 + y * 4 + x + 1))::BIGINT AS digest FROM ver GROUP BY vec_id")
def image_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half as large, normalised, channel by channel, and its bytes back from that."""
    values = P.normalised(P.downscaled(F.col("image"), 0.5))
    rows = _images(spark, sf_dir).select("vec_id", values.alias("v"))
    return rows.select("vec_id", F.aggregate(F.transform("v", lambda v, i: F.round((v * 0.5 + 0.5) * 255).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v).alias("digest"))


@query(f"WITH {PX}, g AS (SELECT vec_id, y, x, (sum(v * [{', '.join(map(str, P.GREY))}][c + 1])::BIGINT + {1 << (P.GREY_BITS - 1)}) >> {P.GREY_BITS} AS g FROM px GROUP BY vec_id, y, x), r AS (SELECT vec_id, y, x, unnest(range(3)) AS c, g AS v FROM g) SELECT vec_id, {DIGEST} FROM r GROUP BY vec_id")
def image_grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("vec_id", _digest(P.grey(F.col("image"))))


ORDER = f"o AS (SELECT vec_id, list_transform(list_sort(list_transform(range(6), lambda i: {{'u': {duck_draw(4, 'patches', 'vec_id', 'i')}, 'i': i}})), lambda z: z.i) AS o FROM embeddings)"
#: Cells of two rows and three columns, 3 x 2 pixels, those of the last column 3 x 3.
CELL = "(y // 3 * 3 + least(x // 2, 2))"


@query(f"""WITH {PX}, {ORDER}, p AS (SELECT vec_id, unnest(range(6)) AS place, unnest(o) AS cell FROM o),
    s AS (SELECT vec_id, place, place // 3 * 5 + y % 3 AS y, place % 3 * 4 + x - least(x // 2, 2) * 2 AS x, c, v FROM px JOIN p USING (vec_id) WHERE {CELL} = cell),
    l AS (SELECT vec_id, y, x, c, v FROM s WHERE x < {W + 4} QUALIFY row_number() OVER (PARTITION BY vec_id, y, x, c ORDER BY place DESC) = 1),
    a AS (SELECT vec_id, y, x, c FROM embeddings, range({H + 2}) AS r(y), range({W + 4}) AS q(x), range(3) AS t(c))
    SELECT vec_id, {DIGEST.replace("v)", "coalesce(v, 255))")} FROM a LEFT JOIN l USING (vec_id, y, x, c) GROUP BY vec_id""")
def image_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells shuffled, with gaps."""
    return _images(spark, sf_dir).select("vec_id", _digest(P.shuffled_patches(F.col("image"), 2, 3, P.patch_order(6, 4, "vec_id"))))


@query(f"WITH {PX}, {ORDER} SELECT vec_id, {DIGEST.replace('v)', f'CASE WHEN list_contains(o[1:3], {CELL}) THEN 255 ELSE v END)')} FROM px JOIN o USING (vec_id) GROUP BY vec_id")
def image_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the cells white."""
    return _images(spark, sf_dir).select("vec_id", _digest(P.blanked_patches(F.col("image"), 2, 3, 0.5, P.patch_order(6, 4, "vec_id"))))


@query(f"""WITH {PX}, b AS (SELECT vec_id, floor({duck_draw(2, 'crop/x', 'vec_id')} * 4)::BIGINT AS l, floor({duck_draw(2, 'crop/y', 'vec_id')} * 2)::BIGINT AS t FROM embeddings)
    SELECT vec_id, l AS "left", t AS top, {DIGEST} FROM px JOIN b USING (vec_id) WHERE x >= l AND x < l + 4 AND y >= t AND y < t + 5 GROUP BY vec_id, l, t""")
def image_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn box of 4 x 5 pixels."""
    rows = _images(spark, sf_dir).withColumn("box", P.crop_box(F.col("image"), 5, 4, 2, "vec_id"))
    return rows.select("vec_id", "box.left", "box.top", _digest(P.cropped(F.col("image"), F.col("box"))))
