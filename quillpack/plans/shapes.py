"""Compositions, position ids, shifted losses, block masks, plan items and zipped lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import mathx as M
from ..functions import text as T
from ..functions.draws import duck_draw
from ..operators import elements as E
from ..operators import layout as L
from ..operators import reductions as R
from ..sources.datasets import zipped
from .registry import duck_words, query, table


def _cuts(seed: int, n: str) -> str:
    drawn = f"list_sort(list_transform(range(1, total), lambda i: {{'u': {duck_draw(seed, 'composition/cut', 'event_id', 'i')}, 'i': i}}))"
    return f"list_concat(list_concat([0], list_sort(list_transform({drawn}[1 : {n} - 1], lambda x: x.i))), [total])"


@query(f"""WITH t AS (SELECT event_id, (user_id % 40 + 1)::BIGINT AS total, {duck_draw(5, 'composition/n', 'event_id')} AS u, {duck_draw(6, 'composition/n', 'event_id')} AS v FROM events),
    n AS (SELECT *, 1 + floor(u * total)::BIGINT AS n, least(total, 1 + floor(ln(1.0 - v * (1.0 - 0.9::DOUBLE ** total)) / ln(0.9::DOUBLE))::BIGINT) AS k FROM t),
    e AS (SELECT event_id, {_cuts(5, 'n')} AS a, {_cuts(6, 'k')} AS b FROM n)
    SELECT event_id, array_to_string(a, ',') AS even, array_to_string(list_transform(range(1, len(b)), lambda i: b[i + 1] - b[i]), ',') AS geometric FROM e""")
def compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of an even composition, and parts of a geometric one."""
    total = F.col("user_id") % 40 + 1
    rows = table(spark, sf_dir, "events").select("event_id", A.composition(total, 1.0, 5, "event_id").alias("a"), A.composition(total, 0.9, 6, "event_id").alias("b"))
    return rows.select("event_id", F.array_join(F.col("a.ends").cast("array<string>"), ",").alias("even"), F.array_join(F.col("b.parts").cast("array<string>"), ",").alias("geometric"))


SIDE = 26
BUCKET = f"(SELECT count(*) FROM range(1, {SIDE}) AS b(k) WHERE (1::DOUBLE / {SIDE} + (k - 1) * (1::DOUBLE / {SIDE}))::FLOAT <= (i * (1::DOUBLE / n))::FLOAT)"


@query(f"""WITH s AS (SELECT DISTINCT unnest([p_partkey % 37, p_size % 29 + 1]) AS n FROM part), f AS (SELECT n, i, {BUCKET} AS b FROM s, unnest(range(n)) AS u(i)),
    x AS (SELECT p_partkey, y.i AS i, x.i AS j, y.b * {SIDE} + x.b AS id FROM part JOIN f y ON y.n = p_partkey % 37 JOIN f x ON x.n = p_size % 29 + 1),
    g AS (SELECT p_partkey, md5(string_agg(id::VARCHAR, ',' ORDER BY i, j)) AS ids FROM x GROUP BY p_partkey)
    SELECT p_partkey, coalesce(ids, md5('')) AS ids FROM part LEFT JOIN g USING (p_partkey)""")
def interpolated_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of many sizes, finer and coarser than the table of positions, and of its very size."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 37).alias("h"), (F.col("p_size") % 29 + 1).alias("w"))
    # few sizes: a size's ids are worked out once and joined
    ids = A.interpolated_ids(F.col("h"), F.col("w"), SIDE)
    sizes = rows.select("h", "w").distinct().select(F.col("h").alias("h_"), F.col("w").alias("w_"), F.md5(F.array_join(ids.cast("array<string>"), ",")).alias("ids"))
    return rows.join(sizes, F.col("h").eqNullSafe(F.col("h_")) & F.col("w").eqNullSafe(F.col("w_"))).select("p_partkey", "ids")


@query("""WITH l AS (SELECT vec_id // 8 AS seq, vec_id % 8 AS pos, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE * 5 AS x FROM embeddings),
    t AS (SELECT vec_id // 8 AS seq, vec_id % 8 AS pos, lead(CASE WHEN vec_id % 5 = 0 THEN -100 ELSE vec_id * 7 % 64 END) OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) AS label FROM embeddings),
    s AS (SELECT seq, pos, label, max(x) + ln(sum(exp(x - m))) - max(CASE WHEN k = label THEN x END) AS nll FROM (SELECT *, max(x) OVER (PARTITION BY seq, pos) AS m FROM l) JOIN t USING (seq, pos) WHERE label <> -100 GROUP BY ALL)
    SELECT round(avg(nll), 6) AS loss, count(*) AS n FROM s""")
def shifted_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as logits of sequences of eight, a fifth of their labels ignored."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("seq"), (F.col("vec_id") % 8).alias("pos"), "vec_id", "embedding")
    logits = rows.select("seq", "pos", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double") * 5)
    labels = rows.select("seq", "pos", F.when(F.col("vec_id") % 5 == 0, -100).otherwise(F.col("vec_id") * 7 % 64).alias("label"))
    return R.shifted_cross_entropy(logits, labels).select(F.round("loss", 6).alias("loss"), "n")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, [vec_id // 16 % 16, vec_id % 16]::DOUBLE[] AS p FROM embeddings)
    SELECT vec_id, round(list_sum(list_transform(range(64), lambda k: (k + 1) * (v[k + 1] * cos(p[k // 32 + 1] / 10000.0 ** (k % 16 / 16.0)) + CASE WHEN k % 32 < 16 THEN -v[k + 17] ELSE v[k - 15] END * sin(p[k // 32 + 1] / 10000.0 ** (k % 16 / 16.0))))), 4) AS digest FROM e""")
def rotary_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 64 turned by their patches' rows and columns in a grid of 16."""
    x = M.rotated_2d(F.col("embedding").cast("array<double>"), F.floor(F.col("vec_id") / 16) % 16, F.col("vec_id") % 16)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    return rows.select("vec_id", F.round(F.aggregate(F.transform("x", lambda v, k: (k + 1) * v), F.lit(0.0), lambda a, v: a + v), 4).alias("digest"))


@query(f"""WITH n AS (SELECT conv_id, sum(len({duck_words('text')}))::BIGINT AS n FROM conversations GROUP BY conv_id), q AS (SELECT conv_id, n, unnest(range(n)) AS q FROM n),
    p AS (SELECT conv_id, q // 16 AS q_block, k // 16 AS k_block, n, NOT (k < conv_id % 5 OR k % 11 = 3) AND (conv_id % 2 = 1 OR k <= q) AS may FROM (SELECT *, unnest(range(n)) AS k FROM q))
    SELECT conv_id, q_block::INT AS q_block, k_block::INT AS k_block, count(*) FILTER (may) AS pairs, count(*) FILTER (may) = count(*) AS whole FROM p GROUP BY ALL HAVING count(*) FILTER (may) > 0""")
def mask_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 16 of the masks of conversations, padded in front and here and there; every second one is causal."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.n_tokens(F.col("text"))).cast("int").alias("n")).where("n > 0")
    mask = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when((i < F.col("conv_id") % 5) | (i % 11 == 3), 0).otherwise(1).cast("long"))
    return L.mask_blocks(rows.withColumn("mask", mask), ["conv_id"], "mask", F.col("conv_id") % 2 == 0, 16).select("conv_id", F.col("q_block").cast("int").alias("q_block"), F.col("k_block").cast("int").alias("k_block"), "pairs", "whole")


@query("""WITH f AS (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS day, event_id, 64 + user_id % 5 * 16 AS h, 64 + event_id % 7 * 16 AS w FROM events)
    SELECT user_id, day, (row_number() OVER v - 1)::INT AS k, CASE WHEN user_id % 2 = 1 THEN 0 ELSE user_id % 3 % 2 END::INT AS enable_cfg, (user_id % 2)::INT AS loss, row_number() OVER v = 1 AS split_start, lead(event_id) OVER v IS NULL AS split_end,
        coalesce(lead(event_id) OVER v - event_id, -1)::BIGINT AS frame_delta, (sum(w * h // 256) OVER (PARTITION BY user_id, day))::BIGINT AS num_tokens FROM f WINDOW v AS (PARTITION BY user_id, day ORDER BY event_id)""")
def video_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day as the frames of a video; users with odd numbers are targets."""
    u, e = F.col("user_id"), F.col("event_id")
    frame = F.struct(e.alias("index"), (64 + u % 5 * 16).alias("h"), (64 + e % 7 * 16).alias("w"))
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("day")
    videos = table(spark, sf_dir, "events").groupBy("user_id", day).agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    plans = videos.select("user_id", "day", E.frame_tokens(F.col("frames"), 16).alias("num_tokens"), F.posexplode(E.video_items(F.col("frames"), (u % 2).cast("int"), (u % 3 % 2).cast("int"))).alias("k", "item"))
    return plans.select("user_id", "day", "k", "item.enable_cfg", "item.loss", "item.split_start", "item.split_end", F.coalesce("item.frame_delta", F.lit(-1).cast("long")).alias("frame_delta"), "num_tokens")


@query(f"SELECT conv_id, turn, 'text' AS type, 1 AS enable_cfg, (role = 'assistant')::INT AS loss, true AS split_start, true AS split_end, len({duck_words('text')})::BIGINT AS n FROM conversations")
def text_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = E.text_item((F.col("role") == "assistant").cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", item.alias("i"), T.n_tokens(F.col("text")).alias("n")).select("conv_id", "turn", "i.type", "i.enable_cfg", "i.loss", "i.split_start", "i.split_end", "n")


@query("""WITH c AS (SELECT c_name, (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS line FROM customer), s AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS line FROM supplier),
    p AS (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS line FROM part) SELECT line, c_name, s_name, p_name FROM c JOIN s USING (line) JOIN p USING (line)""")
def zipped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists of different lengths side by side, cut to the shortest."""
    numbered = lambda name, key, column: table(spark, sf_dir, name).select(F.col(column), (F.row_number().over(Window.orderBy(key)) - 1).cast("long").alias("line"))
    return zipped(numbered("customer", "c_custkey", "c_name"), numbered("supplier", "s_suppkey", "s_name"), numbered("part", "p_partkey", "p_name"))
