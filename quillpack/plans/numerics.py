"""Shards, mixtures, positions, media sizes, schedules, decoding steps and reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import mathx as M
from ..functions import media as V
from ..functions.draws import draw, draw_normal, duck_draw
from ..operators import decoding as D
from ..operators import layout as L
from ..operators import reductions as R
from ..operators import shards as S
from .registry import duck_words, query, table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard list: one path a day of events."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("events/"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".parquet")).alias("path")).distinct()


FILES = "files AS (SELECT DISTINCT concat('events/', strftime(ts, '%Y-%m-%d'), '.parquet') AS path FROM events)"


@query(f"""WITH {FILES}, o AS (SELECT path, row_number() OVER (ORDER BY {duck_draw(42, 'shards', 'path')}, path) - 1 AS i, count(*) OVER () AS n FROM files)
    SELECT path, (i // (n // 2))::INT AS rank, ((i % (n // 2)) // (n // 2 // 3))::INT AS worker, (n // 2 // 3 - 1 - (i % (n // 2)) % (n // 2 // 3))::BIGINT AS place
    FROM o WHERE i < n // 2 * 2 AND i % (n // 2) < n // 2 // 3 * 3""")
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.assigned(_files(spark, sf_dir), "path", 42, 2, 3)


@query(f"""WITH {FILES}, o AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS k, count(*) OVER () AS n FROM files) SELECT path, i FROM range(50) AS r(i) JOIN o ON k = i % n""")
def shard_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quota(_files(spark, sf_dir), "path", 50)


WEIGHTS = {"edit": 1.0, "t2i": 2.0, "vlm": 5.0}
PICK = f"(SELECT event_id, value, {duck_draw(1, 'mixture', 'event_id')} AS u FROM events)"


@query(f"SELECT event_id, CASE WHEN u < 0.125 THEN 'edit' WHEN u < 0.375 THEN 't2i' ELSE 'vlm' END AS grp FROM {PICK}")
def mixture_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", S.picked(e, WEIGHTS, 1, "event_id").alias("grp"))


@query("""WITH g AS (SELECT source, sum(n_chars)::DOUBLE AS weight FROM documents GROUP BY source) SELECT source, weight, round(sum(weight) OVER (ORDER BY source) / sum(weight) OVER (), 9) AS high,
    round(coalesce(sum(weight) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(weight) OVER (), 9) AS low FROM g""")
def mixture_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").cast("double").alias("weight"))
    return S.intervals(g, "source", "weight").select("source", "weight", F.round("high", 9).alias("high"), F.round("low", 9).alias("low"))


@query("SELECT event_id, user_id FROM events WHERE (user_id, event_id) > (40, 500)")
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.after(table(spark, sf_dir, "events"), (40, 500), "user_id", "event_id").select("event_id", "user_id")


@query(f"""SELECT event_type, worker, arg_max(user_id, s) AS file, arg_max(event_id, s) AS row FROM (SELECT event_type, (user_id % 4)::INT AS worker, user_id, event_id, {duck_draw(2, 'consumed', 'event_id')} + event_id / 1e12 AS s FROM events) GROUP BY ALL""")
def offset_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).cast("int").alias("worker"), F.col("user_id").alias("file"), F.col("event_id").alias("row"))
    return S.offsets(e.withColumn("s", draw(2, "consumed", "row") + F.col("row") / F.lit(1e12)), ["event_type", "worker"], "s", "file", "row")


@query("SELECT lpad(max(o_orderkey)::VARCHAR, 7, '0') AS name FROM orders")
def latest_ckpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 7, "0").alias("name"))
    return S.latest(names, "name")


# media


def _div(v: str, s: int) -> str:
    return f"greatest({s}, (round_even(({v}) / {s}.0, 0) * {s})::BIGINT)"


def _resize(longest: int, shortest: int, stride: int, pixels: int) -> str:
    return f"""WITH d AS (SELECT p_partkey, (p_size * 37 + 13)::DOUBLE AS w, (p_partkey % 97 * 29 + 40)::DOUBLE AS h FROM part),
        a AS (SELECT *, greatest(least({longest} / greatest(w, h), 1.0), {shortest} / least(w, h)) AS k FROM d),
        b AS (SELECT p_partkey, {_div('round_even(w * k, 0)', stride)} AS w, {_div('round_even(h * k, 0)', stride)} AS h FROM a),
        c AS (SELECT p_partkey, CASE WHEN w * h > {pixels} THEN {_div(f'round_even(w * ({pixels}.0::DOUBLE / (w * h)), 0)', stride)} ELSE w END AS w, CASE WHEN w * h > {pixels} THEN {_div(f'round_even(h * ({pixels}.0::DOUBLE / (w * h)), 0)', stride)} ELSE h END AS h FROM b)
        SELECT p_partkey, (CASE WHEN greatest(w, h) > {longest} THEN {_div(f'round_even(w * ({longest}.0::DOUBLE / greatest(w, h)), 0)', stride)} ELSE w END)::BIGINT AS w, (CASE WHEN greatest(w, h) > {longest} THEN {_div(f'round_even(h * ({longest}.0::DOUBLE / greatest(w, h)), 0)', stride)} ELSE h END)::BIGINT AS h FROM c"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 + 13).cast("double").alias("w0"), (F.col("p_partkey") % 97 * 29 + 40).cast("double").alias("h0"))


@query(_resize(1024, 512, 16, 1806336))
def resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = V.resized(F.col("w0"), F.col("h0"), 1024, 512, 16, 1806336)
    return _sizes(spark, sf_dir).select("p_partkey", w.alias("w"), h.alias("h"))


@query(f"WITH r AS ({_resize(980, 378, 14, 501760)}) SELECT p_partkey, ((h // 14) * (w // 14))::BIGINT AS n FROM r")
def patch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of images that share their pixels with three others."""
    w, h = V.resized(F.col("w0"), F.col("h0"), 980, 378, 14, 2007040, 4)
    return _sizes(spark, sf_dir).select("p_partkey", w.alias("w"), h.alias("h")).select("p_partkey", V.patches(F.col("w"), F.col("h"), 14).alias("n"))


@query("""SELECT p_partkey, list_sum(l)::BIGINT AS total, l[-1]::BIGINT AS last, len(l)::BIGINT AS n FROM (SELECT p_partkey, list_transform(range((p_size % 9 + 1) * (p_partkey % 7 + 1)), lambda k: (k // (p_partkey % 7 + 1)) * 70 + k % (p_partkey % 7 + 1)) AS l FROM part)""")
def pos_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = A.grid_ids((F.col("p_size") % 9 + 1).cast("long"), F.col("p_partkey") % 7 + 1, 70)
    rows = table(spark, sf_dir, "part").select("p_partkey", ids.alias("l"))
    return rows.select("p_partkey", F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.element_at("l", -1).alias("last"), F.size("l").cast("long").alias("n"))


@query("""SELECT vec_id, k AS patch, round(sum(v * (spot + 1)), 4) AS digest FROM (SELECT vec_id, (y // 4) * 2 + x // 4 AS k, (y % 4) * 4 + x % 4 AS spot, v FROM (SELECT vec_id, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) AS r(i))) GROUP BY ALL""")
def patchify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(A.patchify(F.col("embedding"), 1, 8, 8, 4)).alias("patch", "v"))
    at = F.transform("v", lambda x, i: x.cast("double") * (i + 1))
    return rows.select("vec_id", F.col("patch").cast("long").alias("patch"), F.round(F.aggregate(at, F.lit(0.0), lambda a, x: a + x), 4).alias("digest"))


@query("""WITH c AS (SELECT event_id, (event_id % 211 + 1)::BIGINT AS total, least(8, event_id % 211 + 1)::BIGINT AS k FROM events),
    f AS (SELECT event_id, k, list_transform(range(k), lambda i: (floor(i * total::DOUBLE / k) + floor((i + 1) * total::DOUBLE / k) - 1)::BIGINT // 2) AS l FROM c)
    SELECT event_id, array_to_string(list_concat(l, list_transform(range(8 - k), lambda i: l[-1])), ',') AS frames FROM f""")
def frames_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.frames_middle((F.col("event_id") % 211 + 1).cast("long"), 8)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(f.cast("array<string>"), ",").alias("frames"))


@query("""WITH c AS (SELECT event_id, (event_id % 173 + 1)::BIGINT AS total, (event_id % 4 * 5 + 15)::DOUBLE AS fps FROM events),
    t AS (SELECT *, list_filter(list_transform(range(greatest(ceil(total / fps / 0.5)::BIGINT, 1)), lambda i: i * 0.5::DOUBLE + 0.25), lambda x: x < total / fps + 0.25) AS ts FROM c)
    SELECT event_id, array_to_string(list_filter(list_transform(ts, lambda x: round_even(x * fps, 0)::BIGINT), lambda i: i < total)[1:6], ',') AS frames FROM t""")
def frames_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.frames_rate((F.col("event_id") % 173 + 1).cast("long"), (F.col("event_id") % 4 * 5 + 15).cast("double"), 2.0, 6)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(f.cast("array<string>"), ",").alias("frames"))


@query("""SELECT user_id, event_id, coalesce(lead(event_id) OVER w - event_id, -1) AS delta, lag(event_id) OVER w IS NULL AS is_first, lead(event_id) OVER w IS NULL AS is_last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def frame_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.frame_deltas(table(spark, sf_dir, "events"), ["user_id"], "event_id").withColumn("delta", F.coalesce("delta", F.lit(-1).cast("long")))


# decoding: an embedding is a sequence of 64 positions with a confidence each

LOGITS = "l AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


@query(f"WITH {LOGITS} SELECT vec_id, pos FROM l QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) <= 5")
def topk_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_transfers(_logits(spark, sf_dir), "vec_id", "pos", "x", 5).select("vec_id", "pos")


@query(f"WITH {LOGITS} SELECT vec_id, pos FROM l QUALIFY x >= 0.3 OR row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) = 1")
def threshold_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.threshold_transfers(_logits(spark, sf_dir), "vec_id", "pos", "x", 0.3).select("vec_id", "pos")


@query(f"WITH {LOGITS} SELECT vec_id, pos, round(exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY vec_id), 9) AS p FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM l)")
def softmax_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.confidences(_logits(spark, sf_dir), ["vec_id"], "pos", "x").select("vec_id", "pos", F.round("p", 9).alias("p"))


@query(f"WITH {LOGITS} SELECT vec_id, arg_max(pos, (x, -pos)) AS pos FROM l GROUP BY vec_id")
def argmax_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.argmax(_logits(spark, sf_dir), ["vec_id"], "pos", "x").select("vec_id", "pos")


@query(f"WITH {LOGITS} SELECT vec_id, arg_max(pos, (exp(x) / (-ln(u)) ** 0.7, -pos)) AS pos FROM (SELECT *, greatest({duck_draw(4, 'gumbel', 'vec_id', 'pos')}, 1e-9) AS u FROM l) GROUP BY vec_id")
def gumbel_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.greatest(draw(4, "gumbel", "vec_id", "pos"), F.lit(1e-9))
    return D.argmax(_logits(spark, sf_dir).withColumn("x", M.gumbel(F.col("x"), u, 0.7)), ["vec_id"], "pos", "x").select("vec_id", "pos")


@query("SELECT conv_id, turn, array_to_string(list_transform(range(8), lambda i: length(text) // 8 + (i < length(text) % 8)::INT), ',') AS steps FROM conversations")
def transfer_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = A.transfer_counts(F.length("text"), 8)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(steps.cast("array<string>"), ",").alias("steps"))


@query(f"""WITH w AS (SELECT doc_id, {duck_words('text')} AS w FROM documents) SELECT doc_id, CASE WHEN list_position(w, 'the') > 0 THEN list_position(w, 'the') ELSE len(w) END::BIGINT AS valid, len(w)::BIGINT AS total FROM w""".replace("END::BIGINT", "END"))
def eos_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text up to the first 'the', as an end mark."""
    from ..functions.text import words

    rows = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w"))
    at = F.array_position("w", "the")
    return rows.select("doc_id", F.when(at > 0, at).otherwise(F.size("w")).cast("long").alias("valid"), F.size("w").cast("long").alias("total"))


PAIR = "p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS v, b.embedding::DOUBLE[] AS u FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("v")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("u")), "vec_id")


@query(f"WITH {PAIR} SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(v, u), lambda z: (z[2] + 4.0 * (z[1] - z[2])) ** 2))), 6) AS norm FROM p")
def cfg_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(spark, sf_dir).select("vec_id", F.round(M.norm(M.guided(F.col("v"), F.col("u"), F.lit(4.0))), 6).alias("norm"))


@query(f"WITH {PAIR}, c AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nv, sqrt(list_sum(list_transform(list_zip(v, u), lambda z: (z[2] + 4.0 * (z[1] - z[2])) ** 2))) AS nc FROM p) SELECT vec_id, round(nc * least(greatest(nv / (nc + 1e-8), 0.2), 1.0), 6) AS norm FROM c")
def cfg_renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.guided(F.col("v"), F.col("u"), F.lit(4.0))
    return _pair(spark, sf_dir).select("vec_id", F.round(M.norm(M.renormalised(F.col("v"), c, 0.2)), 6).alias("norm"))


SHIFTED = "3.0 * (1 - event_id % 50 / 49.0) / (1 + 2.0 * (1 - event_id % 50 / 49.0))"


@query(f"SELECT event_id, round({SHIFTED}, 9) AS t, CASE WHEN {SHIFTED} > 0.4 AND {SHIFTED} <= 1.0 THEN 4.0 ELSE 1.0 END::DOUBLE AS scale FROM events")
def timestep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an event stands on a grid of 50 points, shifted, and the guidance there."""
    t = M.shifted(1.0 - F.col("event_id") % 50 / 49.0, 3.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(t, 9).alias("t"), M.gated(t, 0.4, 1.0, 4.0).alias("scale"))


@query(f"WITH {PAIR}, t AS (SELECT *, 1 / (1 + exp(-(vec_id % 7 - 3.0))) AS t FROM p) SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(v, u), lambda z: ((1 - t) * z[1] + t * z[2]) ** 2))), 6) AS mix, round(sqrt(list_sum(list_transform(list_zip(v, u), lambda z: (z[2] - z[1]) ** 2))), 6) AS target FROM t")
def flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pair(spark, sf_dir).select("vec_id", F.col("v").cast("array<double>").alias("v"), F.col("u").cast("array<double>").alias("u"), M.sigmoid(F.col("vec_id") % 7 - 3.0).alias("t"))
    return rows.select("vec_id", F.round(M.norm(M.flow_mix(F.col("v"), F.col("u"), F.col("t"))), 6).alias("mix"), F.round(M.norm(M.flow_target(F.col("v"), F.col("u"))), 6).alias("target"))


@query(f"SELECT event_id, round(sqrt(-2 * ln(1 - {duck_draw(8, 'step/a', 'event_id')})) * cos(2 * pi() * {duck_draw(8, 'step/b', 'event_id')}), 6) AS t FROM events")
def timestep_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(draw_normal(8, "step", "event_id"), 6).alias("t"))


# reductions


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0) SELECT q.vec_id AS q, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6) AS cosine FROM q, embeddings e""")
def pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries are the vectors whose id is divisible by 100; all vectors meet them."""
    e = table(spark, sf_dir, "embeddings")
    return R.cosine_to_queries(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding").select("q", "vec_id", F.round("cosine", 6).alias("cosine"))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT q.vec_id AS q, e.vec_id AS k, 10 * list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))) - 10 AS x FROM q, embeddings e)
    SELECT round(avg(s), 6) AS loss FROM (SELECT q, sum(ln(1 + exp(-CASE WHEN q = k THEN x ELSE -x END))) AS s FROM c GROUP BY q)""")
def pair_sigmoid_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return R.sigmoid_loss_to_queries(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10.0, -10.0).select(F.round("loss", 6).alias("loss"))


@query("SELECT event_type, round(sum(value) / count(value), 6) AS ce, round(sum(value * (user_id + 1)) / sum(user_id + 1), 6) AS weighted FROM events GROUP BY event_type")
def ce_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = (F.col("user_id") + 1).cast("double")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value") / F.count("value"), 6).alias("ce"), F.round(F.sum(F.col("value") * w) / F.sum(w), 6).alias("weighted"))


@query("SELECT count(*) AS n, round(avg(m), 6) AS mean FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id)")
def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("mean"))


@query("SELECT event_id, round(value * 1.0 + user_id * 0.25 + event_id * 0.01, 6) AS loss FROM events")
def loss_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(R.combined({"value": 1.0, "user_id": 0.25, "event_id": 0.01}), 6).alias("loss"))


@query("SELECT user_id, max(value) AS peak, count(*) AS n, sum(value > 50)::BIGINT AS over FROM events GROUP BY user_id".replace("sum(value > 50)", "sum((value > 50)::INT)"))
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("peak"), F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("long")).alias("over"))


@query(f"WITH {PAIR} SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(v, u), lambda z: (z[1] * 0.9999 + z[2] * (1.0 - 0.9999)) ** 2))), 6) AS norm FROM p")
def ema_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.zip_with("v", "u", lambda a, b: M.moving_average(a.cast("double"), b.cast("double"), 0.9999))
    return _pair(spark, sf_dir).select("vec_id", F.round(M.norm(new), 6).alias("norm"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)) / len(embedding) + 1e-5))), 5) AS total FROM embeddings")
def rms_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.rms_normalised(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda a, b: a + F.abs(b)), 5).alias("total"))


@query("SELECT label, k::INT AS dim, round(avg(v), 6) AS value FROM (SELECT label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mean_pooled(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "dim", F.round("value", 6).alias("value"))


@query("""SELECT p_partkey, round(list_sum(list_transform(range(32), lambda k: (k + 1) * CASE WHEN k % 16 < 8 THEN sin(p[k // 16 + 1] / 10000.0 ** (k % 8 / 8.0)) ELSE cos(p[k // 16 + 1] / 10000.0 ** (k % 8 / 8.0)) END)), 6) AS digest
    FROM (SELECT p_partkey, [p_partkey % 16, p_size % 16]::DOUBLE[] AS p FROM part)""")
def sincos_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place in a grid by sines and cosines of its column, then of its row."""
    x = M.table_2d(F.col("p_size") % 16, F.col("p_partkey") % 16, 32)
    rows = table(spark, sf_dir, "part").select("p_partkey", x.alias("x"))
    return rows.select("p_partkey", F.round(F.aggregate(F.transform("x", lambda v, k: (k + 1) * v), F.lit(0.0), lambda a, v: a + v), 6).alias("digest"))


@query("""SELECT o_orderkey, round(CASE WHEN s < 300 THEN 1e-4 * s / 300 ELSE 1e-4 END, 12) AS constant,
    round(CASE WHEN s < 300 THEN 1e-4 * s / 300 ELSE 1e-6 + (1e-4 - 1e-6) * greatest(0, 0.5 * (1 + cos(pi() * (s - 300) / 4800.0))) END, 12) AS cosine FROM (SELECT o_orderkey, o_orderkey % 5100 AS s FROM orders)""")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learning rates of the steps that orders are used at."""
    s = F.col("o_orderkey") % 5100
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(M.learning_rate(s, 1e-4, 300, 5100), 12).alias("constant"), F.round(M.learning_rate(s, 1e-4, 300, 5100, 1e-6, "cosine"), 12).alias("cosine"))


@query("SELECT conv_id, turn, n, (sum(n) OVER w)::BIGINT - n AS start, max(n) OVER (PARTITION BY conv_id) AS longest FROM (SELECT conv_id, turn, length(text)::BIGINT AS n FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def cu_seqlens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return rows.select("conv_id", "turn", "n", (F.sum("n").over(w) - F.col("n")).alias("start"), F.max("n").over(Window.partitionBy("conv_id")).alias("longest"))


@query("SELECT vec_id, array_to_string(list_transform(range(len(embedding)), lambda i: CASE WHEN embedding[i + 1] > 0 THEN len(list_filter(embedding[1 : i + 1], lambda x: x > 0)) - 1 ELSE 1 END), ',') AS ids FROM embeddings")
def mask_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform("embedding", lambda x: (x > 0).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(L.positions_of_mask(mask).cast("array<string>"), ",").alias("ids"))


@query("SELECT n_chars, 1::BIGINT << len(bin(n_chars)) AS p, round(CASE WHEN n_chars = 0 THEN 0 ELSE 1 / sqrt(n_chars) END, 9) AS w FROM documents")
def length_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("n_chars", A.power_above(F.col("n_chars")).alias("p"), F.round(A.loss_weight(F.col("n_chars"), "square"), 9).alias("w"))


# positional joins and tables


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN o_orderpriority LIKE '1%' AND l_linenumber = 1 THEN -1.0::DOUBLE ELSE l_quantity END AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def scatter_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values written to positions of sequences; an order is a sequence of lines."""
    from ..operators.gathers import scattered

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    new = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(-1.0).alias("q"))
    return scattered(rows, new, ["l_orderkey", "l_linenumber"], "q")


@query("SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::BIGINT AS place FROM lineitem WHERE l_returnflag <> 'N'")
def unpad_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.gathers import unpadded

    return unpadded(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") != "N").select("l_orderkey", "l_linenumber", "place")


@query(f"WITH {LOGITS}, t AS (SELECT vec_id, pos, (floor(abs(x) * 40))::INT AS token FROM l), f AS (SELECT vec_id, min(pos) FILTER (token = 0) AS f, count(*) AS n FROM t GROUP BY vec_id) SELECT vec_id, (CASE WHEN f IS NULL THEN n - 1 ELSE (f - 1 + n) % n END)::BIGINT AS pos FROM f")
def pooled_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.gathers import last_before_pad

    rows = _logits(spark, sf_dir).withColumn("token", F.floor(F.abs("x") * 40).cast("int"))
    return last_before_pad(rows, "vec_id", "pos", "token", 0)


@query("SELECT l_suppkey, max(l_linenumber) AS h, max(l_quantity::INT) AS w FROM lineitem GROUP BY l_suppkey")
def padded_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.gathers import padded_size as of

    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("h"), F.col("l_quantity").cast("int").alias("w"))
    return of(rows, "l_suppkey", "h", "w")


@query("SELECT vec_id, round(list_sum(list_transform(range(64), lambda k: (k + 1) * CASE WHEN k < 32 THEN v[k + 1] * cos(a[k + 1]) - v[k + 33] * sin(a[k + 1]) ELSE v[k + 1] * cos(a[k - 31]) + v[k - 31] * sin(a[k - 31]) END)), 4) AS digest FROM (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(range(32), lambda i: vec_id / 10000.0 ** (2.0 * i / 64)) AS a FROM embeddings)")
def rotary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.rotated(F.col("embedding").cast("array<double>"), M.rotary_angles(F.col("vec_id"), 64))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    return rows.select("vec_id", F.round(F.aggregate(F.transform("x", lambda v, k: (k + 1) * v), F.lit(0.0), lambda a, v: a + v), 4).alias("digest"))


@query(f"""WITH c AS (SELECT event_id, (event_id % 61 + 8)::BIGINT AS total, 4::BIGINT AS k FROM events),
    i AS (SELECT event_id, total, k, unnest(range(k)) AS j FROM c),
    b AS (SELECT event_id, total, k, j, floor(j * total::DOUBLE / k)::BIGINT AS lo, floor((j + 1) * total::DOUBLE / k)::BIGINT - 1 AS hi FROM i),
    d AS (SELECT event_id, list(lo + floor({duck_draw(5, 'frame', 'event_id', 'j + 1')} * (hi - lo))::BIGINT ORDER BY j) AS f FROM b GROUP BY ALL)
    SELECT event_id, list_sum(f)::BIGINT AS total FROM d""")
def frames_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.frames_drawn((F.col("event_id") % 61 + 8).cast("long"), 4, 5, "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", f.alias("f"))
    return rows.select("event_id", F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT event_id, round(0.3611 * (value - 0.1159), 9) AS z, round(value / 0.3611 + 0.1159, 6) AS x, floor(greatest(least(value / 100 * 0.5 + 0.5, 1.0), 0.0) * 255)::INT AS pixel FROM events")
def latent_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(M.latent(v), 9).alias("z"), F.round(M.from_latent(v), 6).alias("x"), A.pixel(v / 100).alias("pixel"))
