"""Token-level attention, guidance kinds, frame samplers, latents, look-ups and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import mathx as M
from ..functions import media as V
from ..functions import text as T
from ..functions.draws import draw, duck_draw
from ..operators import decoding as D
from ..operators import elements as E
from ..operators import gathers as G
from ..operators import layout as L
from ..operators import noise as N
from ..operators import reductions as R
from ..operators import shards as S
from .registry import query, table
from .samples import ELEMENTS, PAIRS, SEGMENTS, STATS, TAGGED, segments, tagged

# attention, token by token

MAY = "(q.pos >= k.pos OR q.split_ord = k.split_ord AND q.mode IN ('full', 'noise')) AND NOT (k.mode = 'noise' AND q.split_ord <> k.split_ord)"


@query(f"{PAIRS} SELECT q.conv_id, q.split_ord, count(*) AS pairs FROM tok q JOIN tok k ON q.conv_id = k.conv_id AND {MAY} GROUP BY ALL")
def attn_pairs_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tokens_seen(segments(spark, sf_dir), ["conv_id"]).groupBy("conv_id", "split_ord").agg(F.sum("seen").alias("pairs"))


@query(f"{PAIRS} SELECT q.conv_id, q.pos, md5(string_agg(k.pos::VARCHAR, ',' ORDER BY k.pos)) AS seen FROM tok q JOIN tok k ON q.conv_id = k.conv_id AND {MAY} GROUP BY ALL")
def attn_mask_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token's row of the mask, as the positions that it sees."""
    return L.mask_rows(segments(spark, sf_dir), ["conv_id"], lambda seen: F.md5(F.array_join(seen.cast("array<string>"), ",")))


@query(f"WITH {TAGGED}, {ELEMENTS}, {STATS} SELECT conv_id, turn, n, CASE WHEN has_loss = 1 THEN 1 / sqrt(n) ELSE 0.0::DOUBLE END AS weight, sum(has_loss * n) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS labels FROM items")
def ce_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each token of an answer, and labels so far in the sample."""
    from pyspark.sql import Window

    items = E.flat_elements(tagged(spark, sf_dir)).withColumn("n", T.n_tokens(F.col("text")).cast("long")).where("n > 0")
    weight = A.loss_weight(F.col("n") * F.col("has_loss"), "square")
    return items.select("conv_id", "turn", "n", weight.alias("weight"), F.sum(F.col("has_loss") * F.col("n")).over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("labels"))


@query(f"WITH p AS (SELECT event_id, user_id % 9 AS n, {duck_draw(3, 'mask/t', 'event_id')} * 0.999 + 0.001 AS p FROM events), h AS (SELECT event_id, n, p, unnest(range(n)) AS i FROM p WHERE n > 0),"
       f" m AS (SELECT event_id, count(*) FILTER ({duck_draw(3, 'mask/u', 'event_id', 'i')} < p OR i = n - 1) AS masked, sum(i) FILTER ({duck_draw(3, 'mask/u', 'event_id', 'i')} < p OR i = n - 1)::BIGINT AS places FROM h GROUP BY event_id) SELECT * FROM m")  # fmt: skip
def mask_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks in which the last token always is."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 9).alias("n")).where("n > 0").withColumn("p", N.mask_probability(3, "event_id"))
    hit = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: draw(3, "mask/u", "event_id", i) < F.col("p"))
    m = N.with_last(hit, F.col("n"))
    return rows.select("event_id", F.size(m).cast("long").alias("masked"), F.aggregate(m, F.lit(0).cast("long"), lambda a, i: a + i).alias("places"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN '-inf' ELSE format('{{:.6f}}', round(sqrt(-2 * ln(1 - {duck_draw(5, 'timestep/a', 'l_orderkey', 'l_linenumber % 2')})) * cos(2 * pi() * {duck_draw(5, 'timestep/b', 'l_orderkey', 'l_linenumber % 2')}), 6) + 0.0) END AS timestep FROM lineitem""")
def timestep_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order in two splits; those that came back are noised."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("clean"), (F.col("l_linenumber") % 2).alias("split"))
    t = N.timesteps(rows, ["l_orderkey"], "split", F.col("clean"), 5)
    return t.select("l_orderkey", "l_linenumber", F.when(F.col("clean"), "-inf").otherwise(F.format_string("%.6f", F.round("timestep", 6) + 0.0)).alias("timestep"))


# guidance

THREE = "t AS (SELECT vec_id, label, embedding[1:8] AS v, embedding[9:16] AS u, embedding[17:24] AS w FROM embeddings)"
NORM = "sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE)))"


def _guided(a: str, b: str, scale: float) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[2]::DOUBLE + {scale} * (z[1]::DOUBLE - z[2]::DOUBLE))"


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.slice("embedding", k, 8).cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", part(1).alias("v"), part(9).alias("u"), part(17).alias("w"))


@query(f"WITH {THREE}, a AS (SELECT *, {_guided('v', 'u', 4.0)} AS c FROM t), b AS (SELECT *, {_guided('c', 'w', 1.5)} AS o FROM a), s AS (SELECT vec_id, least(greatest({NORM.format('v')} / ({NORM.format('o')} + 1e-8), 0.0), 1.0) AS k, o FROM b) SELECT vec_id, round(list_sum(list_transform(o, lambda x: x * k)), 6) AS total FROM s")
def guidance_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.guided_by_both(F.col("v"), F.col("u"), F.col("w"), 4.0, 1.5, "channel")
    return _three(spark, sf_dir).select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {THREE}, a AS (SELECT *, {_guided('v', 'u', 4.0)} AS c FROM t), s AS (SELECT *, least(greatest({NORM.format('v')} / ({NORM.format('c')} + 1e-8), 0.1), 1.0) AS k FROM a), r AS (SELECT *, list_transform(c, lambda x: x * k) AS d FROM s) SELECT vec_id, round(list_sum({_guided('d', 'w', 1.5)}), 6) AS total FROM r")
def guidance_text_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.guided_by_both(F.col("v"), F.col("u"), F.col("w"), 4.0, 1.5, "text_channel", 0.1)
    return _three(spark, sf_dir).select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {THREE}, a AS (SELECT *, {_guided('v', 'u', 4.0)} AS c FROM t), b AS (SELECT *, {_guided('c', 'w', 1.5)} AS o FROM a), n AS (SELECT label, sqrt(sum({NORM.format('v')} ** 2)) AS nv, sqrt(sum({NORM.format('o')} ** 2)) AS no FROM b GROUP BY label) SELECT vec_id, round(list_sum(list_transform(o, lambda x: x * least(greatest(nv / (no + 1e-8), 0.0), 1.0))), 6) AS total FROM b JOIN n USING (label)")
def guidance_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a label are the tokens of one sample, whose norms are over all of them."""
    rows = _three(spark, sf_dir)
    out = M.guided(M.guided(F.col("v"), F.col("u"), F.lit(4.0)), F.col("w"), F.lit(1.5))
    norms = rows.groupBy("label").agg(F.sqrt(F.sum(F.pow(M.norm(F.col("v")), 2))).alias("nv"), F.sqrt(F.sum(F.pow(M.norm(out), 2))).alias("no"))
    scaled = M.guided_by_both(F.col("v"), F.col("u"), F.col("w"), 4.0, 1.5, "global", 0.0, (F.col("nv"), F.col("no")))
    return rows.join(norms, "label").select("vec_id", F.round(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {THREE} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x::DOUBLE / {NORM.format('v')})), 6) AS total FROM t")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(spark, sf_dir).select("vec_id", F.round(F.aggregate(M.unit(F.col("v")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {THREE} SELECT vec_id, round(list_sum(list_transform(list_zip(v, u), lambda z: z[1]::DOUBLE - z[2]::DOUBLE * 0.02)), 6) AS total FROM t")
def euler_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.euler(F.col("v"), F.col("u"), F.lit(0.02))
    return _three(spark, sf_dir).select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query("SELECT event_id, round(list_sum(list_transform(range(8), lambda i: cos(value * exp(-ln(10000.0) * i / 8)) + sin(value * exp(-ln(10000.0) * i / 8)))), 6) AS total FROM events")
def timestep_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = M.timestep_embedding(F.col("value"), 17)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# frames

CLIPS = "c AS (SELECT p_partkey, p_size + 0 AS total, 20.0 + p_partkey % 11 AS native FROM part)"


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("total"), (F.lit(20.0) + F.col("p_partkey") % 11).alias("native"))


@query(f"WITH {CLIPS}, t AS (SELECT p_partkey, total, least(8, total) AS n FROM c), f AS (SELECT p_partkey, n, list_transform(range(n), lambda i: floor(i * (total::DOUBLE / n))::BIGINT + 1) AS x FROM t) SELECT p_partkey, array_to_string(x || list_transform(range(8 - n), lambda i: x[n]), ',') AS frames FROM f")
def frames_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir).select("p_partkey", F.array_join(V.frames_fixed(F.col("total"), 8, 1).cast("array<string>"), ",").alias("frames"))


@query(f"WITH {CLIPS} SELECT p_partkey, array_to_string(list_transform(range(6), lambda i: floor(i * (total - 1)::DOUBLE / 5)::BIGINT), ',') AS frames FROM c")
def frames_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir).select("p_partkey", F.array_join(V.frames_spaced(F.col("total"), 6).cast("array<string>"), ",").alias("frames"))


@query(f"WITH {CLIPS} SELECT p_partkey, array_to_string(list_transform(range(ceil((total - 1) / (native / 2.0))::BIGINT), lambda i: floor(i * (native / 2.0))::BIGINT), ',') AS frames FROM c")
def frames_stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir).select("p_partkey", F.array_join(V.frames_stepped(F.col("total"), F.col("native"), 2.0).cast("array<string>"), ",").alias("frames"))


@query(f"WITH {CLIPS} SELECT p_partkey, floor(1.5 * native)::BIGINT AS length, array_to_string(list_transform([0, 4, 9], lambda i: i + floor(0.5 * native)::BIGINT), ',') AS frames FROM c")
def frames_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = F.lit(0.5), F.lit(2.0)
    frames = V.in_clip(F.array(*(F.lit(i).cast("long") for i in (0, 4, 9))), start, F.col("native"))
    return _clips(spark, sf_dir).select("p_partkey", V.clip_length(start, end, F.col("native")).alias("length"), F.array_join(frames.cast("array<string>"), ",").alias("frames"))


@query("SELECT page_id, CASE WHEN ends_with(concat(url, CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END), '/') THEN 'folder' ELSE 'video' END AS source FROM pages")
def frame_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("url", F.when(F.col("page_id") % 3 == 0, "/").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", V.frame_source(path).alias("source"))


# latents and pixels


def _grid(h: int, w: int) -> str:
    """Places (from 1) of a 1-channel grid of 6 columns in the order of 2 x 2 patches of its upper left h x w part."""
    return str([(i * 2 + y) * 6 + j * 2 + x + 1 for i in range(h // 2) for j in range(w // 2) for y in range(2) for x in range(2)])


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip({_grid(2, 4)}, range(8)), lambda z: embedding[z[1]]::DOUBLE * (z[2] + 1))), 5) AS total FROM embeddings")
def latent_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 6 latents cropped to 2 x 4 and cut into patches."""
    x = A.patchify(A.cropped(F.slice("embedding", 1, 24).cast("array<double>"), 1, 4, 6, 2, 4), 1, 2, 4, 2)
    total = F.aggregate(F.transform(F.flatten(x), lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 5).alias("total"))


@query("SELECT vec_id, round(list_sum(list_transform(range(24), lambda i: embedding[i + 1]::DOUBLE * (i + 1))), 5) AS total FROM embeddings")
def latent_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches put together again are the latent."""
    x = A.unpatchify(A.patchify(F.slice("embedding", 1, 24).cast("array<double>"), 1, 4, 6, 2), 1, 4, 6, 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query("SELECT vec_id, round(list_sum(embedding[1:3]), 4) AS first, round(list_sum(embedding[4:8]), 4) AS second FROM embeddings")
def flow_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples of 3 and 5 rows, with two marks each."""
    x = A.unpacked(F.col("embedding").cast("array<double>"), F.array(F.lit(5).cast("long"), F.lit(7).cast("long")))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), 4)
    return table(spark, sf_dir, "embeddings").select("vec_id", total(F.get(x, F.lit(0))).alias("first"), total(F.get(x, F.lit(1))).alias("second"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: floor(greatest(least(x::DOUBLE * 0.5 + 0.5, 1.0), 0.0) * 255)))::BIGINT AS total FROM embeddings")
def pixel_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform(F.col("embedding").cast("array<double>"), A.pixel)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("SELECT event_id, round((value + exp(0.5 * (value % 3)) * 0.25) / 0.3611 + 0.1159, 6) AS x FROM events")
def latent_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = M.sampled_latent(F.col("value"), F.col("value") % 3, F.lit(0.25))
    return table(spark, sf_dir, "events").select("event_id", F.round(M.from_latent(z), 6).alias("x"))


# decoding and steps


@query(f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY {duck_draw(4, 'remask', 'event_id')} DESC, event_id) AS r FROM events) WHERE r <= 3")
def random_remask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", D.drawn_confidence(4, "event_id").alias("c"))
    return D.top_transfers(rows, "user_id", "event_id", "c", 3).select("user_id", "event_id")


@query("SELECT event_id, user_id FROM events WHERE event_id < 300")
def step_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.remaining(table(spark, sf_dir, "events"), "event_id", 200, 500).select("event_id", "user_id")


@query("WITH l AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s FROM events) SELECT user_id, event_id, round((event_id - lag(event_id) OVER w) / nullif(s - lag(s) OVER w, 0), 9) AS rate FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def step_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return S.step_rates(log, ["user_id"], "event_id", "s").select("user_id", "event_id", F.round("rate", 9).alias("rate"))


# look-ups, keys and losses


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return G.gathered(ids, table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").drop("p_partkey")


@query("SELECT c_custkey AS place, o_orderkey AS beam, o_totalprice FROM customer JOIN orders ON o_orderkey = c_custkey * 4 + 1")
def beam_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers take the state of an order each."""
    order = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), (F.col("c_custkey") * 4 + 1).alias("beam"))
    return G.reordered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("beam"), "o_totalprice"), order, "beam", "place").select("place", "beam", "o_totalprice")


@query("WITH h AS (SELECT DISTINCT o_custkey AS k FROM orders), w AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) SELECT 'loaded' AS kind, count(*) AS n, coalesce(sum(k), 0)::BIGINT AS total FROM (SELECT k FROM h INTERSECT SELECT k FROM w) UNION ALL SELECT 'unexpected', count(*), coalesce(sum(k), 0)::BIGINT FROM (SELECT k FROM h EXCEPT SELECT k FROM w) UNION ALL SELECT 'missing', count(*), coalesce(sum(k), 0)::BIGINT FROM (SELECT k FROM w EXCEPT SELECT k FROM h)")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    want = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    parts = zip(("loaded", "unexpected", "missing"), G.key_difference(have, want, "k"), strict=True)
    rows = [d.agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("total")).select(F.lit(name).alias("kind"), "n", "total") for name, d in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT user_id, event_id AS pos, 0 AS branch FROM events UNION ALL SELECT user_id, event_id + 100000, 1 FROM events")
def two_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.doubled(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos")), "pos", 100_000)


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_row_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.last_rows(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query("WITH f AS (SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS f, min(event_id) AS b, max(event_id) AS l FROM events GROUP BY user_id), p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, (event_type = 'purchase')::INT AS pad FROM events), a AS (SELECT user_id, min(pos) FILTER (pad = 1) AS f, count(*) AS n FROM p GROUP BY user_id) SELECT user_id, CASE WHEN f IS NULL THEN n - 1 ELSE (f - 1 + n) % n END::BIGINT AS pos FROM a")
def row_before_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("pos"), (F.col("event_type") == "purchase").cast("int").alias("token"))
    return G.last_before_pad(rows, "user_id", "pos", "token", 1)


@query("WITH l AS (SELECT value, least(greatest(user_id - 20, 0), 60) AS a, least(greatest(user_id + 10, 0), 60) AS b FROM events) SELECT round((avg(value) FILTER (a < 60) + avg(value * 2) FILTER (b < 60)) / 2, 6) AS loss FROM l")
def span_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.span_loss(table(spark, sf_dir, "events"), F.col("user_id") - 20, F.col("user_id") + 10, F.lit(60), F.col("value"), F.col("value") * 2)
    return out.select(F.round("loss", 6).alias("loss"))


@query(f"WITH {THREE} SELECT round(avg(list_avg(list_transform(list_zip(v, u), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))), 6) AS mse FROM t")
def squared_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = F.aggregate(F.zip_with("v", "u", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / 8
    return R.squared_error(_three(spark, sf_dir), per).select(F.round("mse", 6).alias("mse"))


@query("WITH n AS (SELECT value, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS x FROM events) SELECT round(avg(ln(1 + abs(value))), 6) AS loss FROM n WHERE x IS NOT NULL")
def next_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.next_token_loss(table(spark, sf_dir, "events"), "user_id", "event_id", F.log(1 + F.abs("value"))).select(F.round("loss", 6).alias("loss"))


@query("SELECT o_orderkey, (42 * 8 + o_orderkey % 8)::BIGINT AS seed FROM orders")
def worker_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", M.worker_seed(42, 8, F.col("o_orderkey") % 8).cast("long").alias("seed"))
