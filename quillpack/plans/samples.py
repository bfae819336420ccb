"""From conversations, captions and documents to elements, packs and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import loss_weight
from ..functions.draws import duck_draw
from ..operators import elements as E
from ..operators import layout as L
from ..operators import noise as N
from ..operators.packing import Limits, next_fit, pack
from ..sources.scratch import shared_path
from ..streaming.packer import PROVIDER, ROCKS, stream_full
from .registry import duck_strip, duck_words, query, table

PUNCT = T.PUNCTUATION.replace("'", "''")

ELEMENTS = f"""
    el AS (SELECT * FROM (SELECT conv_id, turn, 'text' AS type, (role = 'assistant')::INT AS has_loss,
        CASE role WHEN 'user' THEN {duck_strip("replace(text, '<image>', '')")} WHEN 'assistant' THEN text END AS text,
        (count(*) OVER (PARTITION BY conv_id) // 2)::INT AS round FROM tagged) WHERE text <> '')"""
TAGGED = "tagged AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN concat('<image>' , chr(10), text) ELSE text END AS text FROM conversations)"
STATS = f"""
    items AS (SELECT *, len({duck_words("text")}) AS n FROM el WHERE len({duck_words("text")}) > 0),
    stats AS (SELECT conv_id, count(*) AS n_items, sum(has_loss)::BIGINT AS n_loss, sum(n)::BIGINT AS num_tokens, (sum(n) + 2 * count(*))::BIGINT AS est, max(round) AS round FROM items GROUP BY conv_id)"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<image>\n"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").withColumn("text", text)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.plan_stats(E.flat_elements(tagged(spark, sf_dir)))


@query(f"WITH {TAGGED}, {ELEMENTS} SELECT * FROM el")
def conv_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.flat_elements(tagged(spark, sf_dir))


@query(f"WITH {TAGGED}, {ELEMENTS}, {STATS} SELECT * FROM stats")
def conv_plan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir)


@query(f"WITH {TAGGED}, {ELEMENTS}, {STATS} SELECT * FROM stats WHERE n_loss > 0")
def conv_loss_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_loss(stats(spark, sf_dir))


@query(f"WITH {TAGGED}, {ELEMENTS}, {STATS} SELECT round, count(*) AS n, sum(est)::BIGINT AS est FROM stats GROUP BY round")
def conv_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).groupBy("round").agg(F.count("*").alias("n"), F.sum("est").alias("est"))


def packed(source: str, rank: str, worker: str, seq: str, most: int, sample: int, final: str) -> str:
    return f"""WITH RECURSIVE {source}
        , s AS (SELECT {rank} AS rank, {worker} AS worker, {seq} AS seq, est, row_number() OVER (PARTITION BY {rank}, {worker} ORDER BY {seq}) AS k FROM src WHERE est <= {sample}),
        p AS (SELECT rank, worker, seq, est, k, est AS cur, 0 AS pack FROM s WHERE k = 1
            UNION ALL SELECT s.rank, s.worker, s.seq, s.est, s.k, CASE WHEN p.cur + s.est > {most} THEN s.est ELSE p.cur + s.est END, CASE WHEN p.cur + s.est > {most} THEN p.pack + 1 ELSE p.pack END
            FROM p JOIN s ON s.rank = p.rank AND s.worker = p.worker AND s.k = p.k + 1)
        {final}"""


@query(packed(f"{TAGGED}, {ELEMENTS}, {STATS}, src AS (SELECT conv_id, est FROM stats WHERE n_loss > 0)", "(conv_id % 2)::INT", "(conv_id % 6 // 2)::INT", "conv_id", 2048, 2048, "SELECT rank, worker, pack::BIGINT AS pack, count(*) AS n_samples, sum(est)::BIGINT AS tokens FROM p GROUP BY ALL"))
def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranks of three workers; packs of at most 2048 estimated tokens."""
    c = F.col("conv_id")
    rows = E.with_loss(stats(spark, sf_dir)).select((c % 2).cast("int").alias("rank"), F.floor(c % 6 / 2).cast("int").alias("worker"), c.alias("seq"), "est")
    return next_fit(rows, 2048).groupBy("rank", "worker", "pack").agg(F.count("*").alias("n_samples"), F.sum("est").alias("tokens"))


def doc_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select((d % 8).cast("int").alias("rank"), F.floor(d % 64 / 8).cast("int").alias("worker"), d.alias("seq"), (T.n_tokens(F.col("text")) + 2).alias("est"))


DOCS = f"src AS (SELECT doc_id, len({duck_words('text')}) + 2 AS est FROM documents)"


@query(packed(DOCS, "(doc_id % 8)::INT", "(doc_id % 64 // 8)::INT", "doc_id", 4096, 4096, "SELECT rank, worker, seq, est::BIGINT AS est, pack::BIGINT AS pack FROM p"))
def pack_nextfit_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_fit(doc_samples(spark, sf_dir), 4096)


@query(packed(DOCS, "(doc_id % 8)::INT", "(doc_id % 64 // 8)::INT", "doc_id", 4096, 4096, "SELECT count(*) AS packs, sum(t)::BIGINT AS tokens, round(sum(t) / (count(*) * 4096.0), 6) AS fill FROM (SELECT sum(est) AS t FROM p GROUP BY rank, worker, pack)"))
def pack_fill_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = next_fit(doc_samples(spark, sf_dir), 4096).groupBy("rank", "worker", "pack").agg(F.sum("est").alias("t"))
    return packs.agg(F.count("*").alias("packs"), F.sum("t").alias("tokens"), F.round(F.sum("t") / (F.count("*") * F.lit(4096.0)), 6).alias("fill"))


@query(packed("src AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS est FROM lineitem GROUP BY l_orderkey)", "(l_orderkey % 16)::INT", "(l_orderkey % 64 // 16)::INT", "l_orderkey", 1024, 1024, "SELECT rank, worker, max(pack)::BIGINT + 1 AS packs, count(*) AS n, sum(est)::BIGINT AS tokens FROM p GROUP BY rank, worker"))
def pack_nextfit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("est"))
    rows = orders.select((k % 16).cast("int").alias("rank"), F.floor(k % 64 / 16).cast("int").alias("worker"), k.alias("seq"), "est")
    return next_fit(rows, 1024).groupBy("rank", "worker").agg((F.max("pack") + 1).alias("packs"), F.count("*").alias("n"), F.sum("est").alias("tokens"))


LIMITS = Limits(8192, 9216, 4096, 4096, 50)

#: The packer step by step: samples of either kind by place, the buffer as places of free samples.
PACK_FULL = f"""WITH RECURSIVE {DOCS},
    s AS (SELECT (doc_id % 8)::INT AS rank, (doc_id % 64 // 8)::INT AS worker, {{'seq': doc_id, 'est': est}} AS x, doc_id % 5 = 0 AS must FROM src),
    l AS (SELECT rank, worker, coalesce(list(x ORDER BY x.seq) FILTER (NOT must), []) AS f, coalesce(list(x ORDER BY x.seq) FILTER (must), []) AS m FROM s GROUP BY rank, worker),
    p AS (SELECT rank, worker, 0 AS step, f, m, 0 AS pack, 0 AS cur, 0 AS place, []::BIGINT[] AS buf, 1::BIGINT AS fi, 1::BIGINT AS mi, NULL::BIGINT AS seq, NULL::INT AS e_pack, NULL::INT AS e_place, NULL::VARCHAR AS status FROM l
        UNION ALL
        SELECT rank, worker, step + 1, f, m, CASE WHEN flush OR fits AND NOT opening AND cur + x.est >= {LIMITS.target} THEN pack + 1 ELSE pack END,
            CASE WHEN flush OR fits AND NOT opening AND cur + x.est >= {LIMITS.target} THEN 0 WHEN fits THEN cur + x.est ELSE cur END,
            CASE WHEN flush OR fits AND NOT opening AND cur + x.est >= {LIMITS.target} THEN 0 WHEN fits THEN place + 1 ELSE place END,
            CASE WHEN keep THEN list_append(buf, fi) WHEN again THEN buf[2:] ELSE buf END, CASE WHEN opening OR again THEN fi ELSE fi + 1 END, CASE WHEN opening THEN mi + 1 ELSE mi END,
            CASE WHEN NOT keep THEN x.seq END, CASE WHEN fits THEN pack END, CASE WHEN fits THEN place END, CASE WHEN long THEN 'too long' WHEN flush THEN 'dropped at flush' WHEN fits THEN 'packed' END
        FROM (SELECT *, NOT long AND NOT opening AND cur + x.est > {LIMITS.most} AND (again OR len(buf) >= {LIMITS.capacity}) AS flush, NOT long AND NOT opening AND cur + x.est > {LIMITS.most} AND NOT again AND len(buf) < {LIMITS.capacity} AS keep,
                NOT long AND (opening OR cur + x.est <= {LIMITS.most}) AS fits
            FROM (SELECT *, CASE WHEN opening THEN x.est >= {LIMITS.sample} ELSE x.est > {LIMITS.sample} END AS long
                FROM (SELECT *, CASE WHEN opening THEN m[mi] WHEN again THEN f[buf[1]] ELSE f[fi] END AS x
                    FROM (SELECT *, place = 0 AS opening, place > 0 AND cur < {LIMITS.prefer} AND len(buf) > 0 AS again FROM p))) WHERE x IS NOT NULL)),
    ends AS (SELECT rank, worker, unnest(list_concat(list_concat(list_transform(buf, lambda i: f[i].seq), list_transform(f[fi:], lambda y: y.seq)), list_transform(m[mi:], lambda y: y.seq))) AS seq FROM p QUALIFY row_number() OVER (PARTITION BY rank, worker ORDER BY step DESC) = 1)
    SELECT rank, worker, seq, coalesce(e_pack, -1)::BIGINT AS pack, coalesce(e_place, -1)::INT AS place, status FROM p WHERE status IS NOT NULL UNION ALL SELECT rank, worker, seq, -1, -1, 'left' FROM ends"""


def grouped_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_samples(spark, sf_dir).withColumn("group", F.when(F.col("seq") % 5 == 0, "must").otherwise("free")).withColumn("length", F.col("est"))


@query(PACK_FULL)
def pack_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffer, preferred samples, mandatory groups and losses at flushes; -1 for what is in no pack."""
    return pack(grouped_samples(spark, sf_dir), LIMITS, ("must",)).fillna(-1, ["pack", "place"])


@query(PACK_FULL)
def pack_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of samples, which is stopped and goes on from its checkpoint after each third of them."""
    rows = grouped_samples(spark, sf_dir)
    path, out, at = (shared_path(spark, x) for x in ("samples", "packs", "checkpoint"))
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    third = F.least(F.floor((F.col("seq") - low) * 3 / max((high or 0) - (low or 0) + 1, 1)), F.lit(2))
    ends = rows.select("rank", "worker").distinct().select("rank", "worker", F.lit(high).alias("seq"))
    provider = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for k in range(3):
            part = rows.where(third == k)
            (part.unionByName(ends, allowMissingColumns=True) if k == 2 else part).write.mode("append").parquet(path)
            stream = stream_full(spark.readStream.schema(rows.schema).parquet(path), LIMITS, ("must",))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, provider)
    return spark.read.schema(stream.schema).parquet(out).fillna(-1, ["pack", "place"])


CAPTIONS = "(SELECT doc_id, list_transform(string_split(text, '. '), lambda s: s) AS parts FROM documents)"


@query(f"""SELECT doc_id, CASE WHEN len(g) = 0 THEN ' ' ELSE {duck_strip("g[(floor(" + duck_draw(7, 'caption', 'doc_id') + " * len(g)) + 1)::BIGINT]")} END AS caption
    FROM (SELECT doc_id, list_filter(parts, lambda s: {duck_strip('s')} <> '') AS g FROM {CAPTIONS})""")
def caption_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", E.chosen_caption(F.split("text", r"\. ", -1), 7, "doc_id").alias("caption"))


@query(f"""WITH p AS (SELECT doc_id, string_split(replace(text, '. ', '<image>'), '<image>') AS parts FROM documents),
    x AS (SELECT doc_id, len(parts) AS n, unnest(parts) AS s, unnest(range(len(parts))) AS k FROM p)
    SELECT doc_id, sum(({duck_strip('s')} <> '' OR n = 1)::INT)::BIGINT AS texts, sum((k < n - 1 AND k < 5)::INT)::BIGINT AS images,
        md5(string_agg(CASE WHEN n = 1 THEN s ELSE {duck_strip('s')} END, '|' ORDER BY k) FILTER ({duck_strip('s')} <> '' OR n = 1)) AS digest FROM x GROUP BY doc_id""")
def inline_image_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.inline_elements(F.replace("text", F.lit(". "), F.lit("<image>")), 5)
    rows = table(spark, sf_dir, "documents").select("doc_id", e.alias("e"))
    texts = F.filter("e", lambda x: x["type"] == "text")
    return rows.select("doc_id", F.size(texts).cast("long").alias("texts"), F.size(F.filter("e", lambda x: x["type"] == "image")).cast("long").alias("images"), F.when(F.size(texts) > 0, F.md5(F.array_join(F.transform(texts, lambda x: x["text"]), "|"))).alias("digest"))


@query(rf"""WITH t AS (SELECT page_id, concat('<img><|image_1|></img>', url, '<img><|image_', page_id % 4, '|></img> and ', url) AS t FROM pages),
    m AS (SELECT page_id, regexp_split_to_array(t, '<img><\|image_\d+\|></img>') AS parts, regexp_extract_all(t, '<img><\|(image_\d+)\|></img>', 1) AS marks FROM t)
    SELECT page_id, len(list_filter(parts, lambda s: {duck_strip('s')} <> ''))::BIGINT AS texts,
        array_to_string(list_filter(marks, lambda s: s IN ('image_1', 'image_2')), ',') || ',output' AS images FROM m""")
def placeholder_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<img><|image_1|></img>"), "url", F.lit("<img><|image_"), (F.col("page_id") % 4).cast("string"), F.lit("|></img> and "), "url")
    e = E.placeholder_elements(text, F.array(F.lit("image_1.jpg"), F.lit("image_2.jpg"), F.lit("output.jpg")))
    rows = table(spark, sf_dir, "pages").select("page_id", e.alias("e"))
    return rows.select("page_id", F.size(F.filter("e", lambda x: x["type"] == "text")).cast("long").alias("texts"), F.array_join(F.transform(F.filter("e", lambda x: x["type"] == "image"), lambda x: x["text"]), ",").alias("images"))


@query(f"""SELECT doc_id, {duck_strip("replace(string_split(t, '</think>')[-1], '<|endoftext|>', '')")} AS answer
    FROM (SELECT doc_id, concat(lang, '</think> ', text, ' <|endoftext|>') AS t FROM documents)""")
def clean_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("lang", F.lit("</think> "), "text", F.lit(" <|endoftext|>"))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_response(t).alias("answer"))


@query(rf"""SELECT doc_id, {duck_strip(f"regexp_replace(translate(text, '{PUNCT}', ''), '[ \t\n\r\f\x0b]+', ' ', 'g')")} AS text,
    array_to_string(list_transform(string_split(text, ', '), lambda s: translate(s, '{PUNCT}', '')), ', ') AS kept FROM documents""")
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.canonical(F.col("text")).alias("text"), F.array_join(F.transform(F.split("text", ", ", -1), T.remove_punctuation), ", ").alias("kept"))


@query(f"""SELECT doc_id, k::INT AS line, lpad((k + 1)::VARCHAR, 3, '0') AS name, {duck_strip('s')} AS prompt
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents) WHERE {duck_strip('s')} <> ''""")
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import output_name, prompts

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "prompt"))
    return prompts(lines, "prompt", ["doc_id", "line"]).select("doc_id", "line", output_name(F.col("line") + 1).alias("name"), "prompt")


@query(f"""SELECT doc_id, w AS word, (('0x' || substr(md5(w), 1, 8))::BIGINT % 126000)::INT AS id, count(*) AS n FROM (SELECT doc_id, unnest({duck_words('text')}) AS w FROM documents) GROUP BY ALL""")
def default_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, their ids and counts. Texts are dealt by document before they fall into words, so no word is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    words = docs.select("doc_id", F.explode(T.words(F.col("text"))).alias("word"))
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("n")).select("doc_id", "word", T.token_id(F.col("word")).alias("id"), "n")


SEGMENTS = f"""WITH {TAGGED}, {ELEMENTS}, {STATS},
    sp AS (SELECT conv_id, turn, 0 AS k, n + CASE WHEN has_loss = 0 THEN 2 ELSE 1 END AS len, CASE WHEN has_loss = 0 THEN 'full' ELSE 'noise' END AS mode, CASE WHEN has_loss = 0 THEN n + 2 WHEN round = 1 THEN n + 1 ELSE 0 END AS step FROM items
        UNION ALL SELECT conv_id, turn, 1, n + 2, 'full', n + 2 FROM items WHERE has_loss = 1 AND round <> 1),
    seg AS (SELECT conv_id, (row_number() OVER w - 1)::INT AS split_ord, len::BIGINT AS len, mode, (sum(len) OVER w - len)::BIGINT AS start, (sum(step) OVER w - step)::BIGINT AS rope FROM sp WINDOW w AS (PARTITION BY conv_id ORDER BY turn, k ROWS UNBOUNDED PRECEDING))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = E.flat_elements(tagged(spark, sf_dir)).withColumn("n", T.n_tokens(F.col("text"))).where("n > 0")
    return L.segments(items.withColumn("splits", L.text_splits(F.col("n"), F.col("has_loss"), F.col("round"))), ["conv_id"], "turn")


@query(f"{SEGMENTS} SELECT * FROM seg")
def layout_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir)


PAIRS = f"""{SEGMENTS}, tok AS (SELECT conv_id, split_ord, mode, unnest(range(start, start + len)) AS pos FROM seg)"""


@query(f"""{SEGMENTS} SELECT conv_id, split_ord, (len * coalesce(sum(CASE WHEN mode <> 'noise' THEN len ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY split_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len * len)::BIGINT AS pairs FROM seg""")
def attn_pairs_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pair_counts(segments(spark, sf_dir), ["conv_id"])


@query(f"""{SEGMENTS} SELECT conv_id, sum(len)::BIGINT AS kv, max(rope)::BIGINT AS last_rope, count(*) AS splits FROM seg GROUP BY conv_id""")
def layout_rope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).groupBy("conv_id").agg(F.sum("len").alias("kv"), F.max("rope").alias("last_rope"), F.count("*").alias("splits"))


@query(f"""WITH {TAGGED}, {ELEMENTS}, {STATS} SELECT conv_id, turn, CASE WHEN has_loss = 1 THEN 'block' ELSE 'text' END AS kind,
    (sum(n + CASE WHEN has_loss = 1 THEN 0 ELSE 2 END) OVER w)::BIGINT AS kv, (sum(n + CASE WHEN has_loss = 1 THEN 0 ELSE 2 END) OVER w)::BIGINT AS rope FROM items WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context_kv_rope(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = E.flat_elements(tagged(spark, sf_dir)).withColumn("n", T.n_tokens(F.col("text"))).where("n > 0")
    return L.context_events(items.withColumn("kind", F.when(F.col("has_loss") == 1, "block").otherwise("text")), ["conv_id"], "turn")


N_TOK = f"(SELECT doc_id, len({duck_words('text')}) + 1 AS n FROM documents)"


@query(f"""SELECT doc_id, n::BIGINT AS n, (CASE WHEN u < 0.1 THEN n + (1 + floor(a * n)) WHEN u < 0.2 AND n > 16 THEN 1 + floor(c * (n - 1)) ELSE n END)::BIGINT AS target
    FROM (SELECT doc_id, n, {duck_draw(3, 'adapt', 'doc_id')} AS u, {duck_draw(3, 'adapt/add', 'doc_id')} AS a, {duck_draw(3, 'adapt/cut', 'doc_id')} AS c FROM {N_TOK})""")
def adalen(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (T.n_tokens(F.col("text")) + 1).alias("n")
    return table(spark, sf_dir, "documents").select("doc_id", n).select("doc_id", "n", N.adapted_length(F.col("n"), 3, "doc_id").alias("target"))


@query(f"""WITH f AS (SELECT doc_id, (CASE WHEN {duck_draw(3, 'fill', 'doc_id')} < 0.2 THEN CASE WHEN n + 1 > p * 0.75 THEN p ELSE p * 3 // 4 END ELSE n + 1 END)::BIGINT AS n, {duck_draw(3, 'split', 'doc_id')} AS u FROM (SELECT doc_id, n, 1 << len(bin(n + 1)) AS p FROM {N_TOK})),
    k AS (SELECT doc_id, n, u, CASE WHEN n <= 16 THEN [1::BIGINT] ELSE list_filter(list_transform(range(40), lambda i: 1::BIGINT << i), lambda i: i >= n / 512.0 AND i <= n / 16.0) END AS ks FROM f),
    c AS (SELECT doc_id, n, u, ks, list_filter(ks, lambda x, i: u * list_sum(list_transform(ks, lambda y: 0.5::DOUBLE / y)) < list_sum(list_transform(ks[1:i], lambda y: 0.5::DOUBLE / y)))[1] AS k FROM k)
    SELECT doc_id, n, k AS chunks, n - (n // k) * (k - 1) AS first FROM c""")
def determine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", (T.n_tokens(F.col("text")) + 1).alias("len"))
    return N.split_lengths(rows, "len", 3, "doc_id").select("doc_id", F.aggregate("chunks", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.size("chunks").cast("long").alias("chunks"), F.get("chunks", F.lit(0)).alias("first"))


@query(f"""WITH {TAGGED}, {ELEMENTS}, {STATS} SELECT conv_id, turn, (CASE WHEN {duck_draw(5, 'ends', 'conv_id', 'turn')} < CASE WHEN round = 1 THEN 0.15 ELSE 0.10 END THEN floor({duck_draw(5, 'ends/n', 'conv_id', 'turn')} * (n + 1)) ELSE 0 END)::BIGINT AS ends FROM items WHERE has_loss = 1""")
def sft_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = E.flat_elements(tagged(spark, sf_dir)).withColumn("n", T.n_tokens(F.col("text"))).where("n > 0 and has_loss = 1")
    return items.select("conv_id", "turn", N.end_targets(F.col("n"), F.col("round"), 5, "conv_id", "turn").alias("ends"))


def _masks() -> str:
    tries = [f"SELECT conv_id, turn, n, {a} AS a, 0.999 * {duck_draw(9, 'mask/t', str(a), 'conv_id', 'turn')} + 0.001 AS p FROM items WHERE has_loss = 1" for a in range(N.ATTEMPTS)]
    return f"""WITH {TAGGED}, {ELEMENTS}, {STATS}, t AS ({' UNION ALL '.join(tries)}),
        e AS (SELECT conv_id, turn, n, a, p, unnest(range(n)) AS i FROM t),
        h AS (SELECT conv_id, turn, n, a, p, count(*) FILTER ({duck_draw(9, 'mask/u', 'a', 'conv_id', 'turn', 'i')} < p) AS hits FROM e GROUP BY ALL),
        b AS (SELECT conv_id, turn, n, coalesce(arg_min(a, a) FILTER (hits > 0), {N.ATTEMPTS - 1}) AS a FROM h GROUP BY ALL)
        SELECT conv_id, turn, n::BIGINT AS n, greatest(hits, 1)::BIGINT AS masked, round(p, 9) AS p, round(1.0 / p / sqrt(greatest(hits, 1)), 9) AS weight FROM b JOIN h USING (conv_id, turn, n, a)"""


@query(_masks())
def mask_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked positions of answers, redrawn until there is one, and the weight of each."""
    items = E.flat_elements(tagged(spark, sf_dir)).withColumn("n", T.n_tokens(F.col("text"))).where("n > 0 and has_loss = 1")
    rows = items.select("conv_id", "turn", "n", N.masked_positions(F.col("n"), 9, "conv_id", "turn").alias("m"))
    k = F.size("m.positions").cast("long")
    return rows.select("conv_id", "turn", "n", k.alias("masked"), F.round("m.p", 9).alias("p"), F.round(loss_weight(k, "square") / F.col("m.p"), 9).alias("weight"))


IMAGES_FIRST = f"""WITH m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS f, replace(text, '. ', '<image>') AS t FROM conversations),
    e AS (SELECT conv_id, turn, f, CASE WHEN f = 'human' THEN {duck_strip("replace(t, '<image>', '')")} ELSE t END AS t FROM m WHERE f = 'gpt' OR f = 'human' AND {duck_strip("replace(t, '<image>', '')")} <> '')"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one row each; a conversation is a row of the sources that this stands for."""
    who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", who.alias("from"), F.replace("text", F.lit(". "), F.lit("<image>")).alias("value")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


@query(f"""{IMAGES_FIRST} SELECT conv_id, count(*) + 2 AS n, sum((f = 'gpt')::INT)::BIGINT AS n_loss, md5(string_agg(t, '|' ORDER BY turn)) AS digest FROM e GROUP BY conv_id""")
def images_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("conv_id", E.images_first(F.col("turns"), 2).alias("e"))
    texts = F.transform(F.filter("e", lambda x: x["type"] == "text"), lambda x: x["text"])
    return rows.select("conv_id", F.size("e").cast("long").alias("n"), F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x["has_loss"]).alias("n_loss"), F.md5(F.array_join(texts, "|")).alias("digest"))


@query(f"""WITH h AS (SELECT page_id, page_id % 5 + 2 AS n FROM pages),
    t AS (SELECT page_id, n, floor({duck_draw(6, 'edit/start', 'page_id')} * (n - 1))::BIGINT AS s FROM h),
    e AS (SELECT *, s + 1 + floor({duck_draw(6, 'edit/end', 'page_id')} * (least(s + 3, n) - 1 - s))::BIGINT AS x, floor({duck_draw(6, 'edit/merge', 'page_id')} * 2) = 0 AS coin FROM t),
    m AS (SELECT *, x - s > 1 AND coin AS merged FROM e)
    SELECT page_id, s AS first, CASE WHEN merged AND x = n - 1 THEN x - 1 ELSE x END AS last, merged FROM m""")
def edit_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.trajectory((F.col("page_id") % 5 + 2).cast("long"), 6, "page_id")
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.col("t.start").alias("first"), F.col("t.end").alias("last"), F.col("t.merged").alias("merged"))


@query(f"""WITH {TAGGED}, {ELEMENTS} SELECT conv_id, sum(({duck_draw(2, 'dropout', 'conv_id', 'turn', '0')} < 0.3)::INT)::BIGINT AS texts, sum(({duck_draw(2, 'dropout', 'conv_id', 'turn', '1')} < 0.4)::INT)::BIGINT AS rope FROM el GROUP BY conv_id""")
def guidance_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text and an image for each message; a dropped image still makes a step."""
    item = lambda kind: F.struct(F.lit(kind).alias("type"), F.lit(1).alias("enable_cfg"))
    kept = E.kept_items(F.array(item("text"), item("vit_image")), 0.3, 0.4, 0.1, 2, "conv_id", "turn")
    rows = E.flat_elements(tagged(spark, sf_dir)).select("conv_id", F.explode(kept).alias("k"))
    dropped_text = (F.col("k.dropped") & (F.col("k.item.type") == "text")).cast("long")
    return rows.groupBy("conv_id").agg(F.sum(dropped_text).alias("texts"), F.sum("k.rope").cast("long").alias("rope"))


@query(f"""{SEGMENTS}, s AS (SELECT conv_id, split_ord, len, sum(len) OVER (PARTITION BY conv_id ORDER BY split_ord) AS e FROM seg),
    t AS (SELECT conv_id, split_ord // 2 AS sample_ord, max(e) AS e FROM s GROUP BY ALL)
    SELECT s.conv_id, s.split_ord, s.len, min(t.sample_ord)::INT AS sample_ord FROM s JOIN t ON t.conv_id = s.conv_id AND t.e >= s.e GROUP BY ALL""")
def split_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of a flat list given back to samples of two splits each."""
    from ..operators.gathers import regrouped

    segs = segments(spark, sf_dir).select("conv_id", "split_ord", "len")
    samples = segs.groupBy("conv_id", F.floor(F.col("split_ord") / 2).cast("int").alias("sample_ord")).agg(F.sum("len").alias("length"))
    return regrouped(segs, samples, "conv_id")


@query(f"""WITH {TAGGED}, {ELEMENTS}, {STATS}, v AS (SELECT conv_id, turn, n, has_loss = 0 AS is_text, turn = max(turn) OVER (PARTITION BY conv_id) AND has_loss = 0 AS newest, CASE WHEN has_loss = 1 THEN 1 ELSE n + 2 END AS step FROM items)
    SELECT conv_id, sum(n + 2)::BIGINT AS kv, sum(step)::BIGINT AS rope, sum(CASE WHEN newest THEN 0 ELSE n + 2 END)::BIGINT AS kv_no_text, sum(CASE WHEN newest THEN 0 ELSE step END)::BIGINT AS rope_no_text,
        sum(CASE WHEN is_text THEN n + 2 ELSE 0 END)::BIGINT AS kv_no_image, sum(CASE WHEN is_text THEN step ELSE 0 END)::BIGINT AS rope_no_image FROM v GROUP BY conv_id""")
def request_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions stand for texts, answers for images."""
    items = E.flat_elements(tagged(spark, sf_dir)).withColumn("n", T.n_tokens(F.col("text"))).where("n > 0")
    return L.request_contexts(items.withColumn("kind", F.when(F.col("has_loss") == 1, "image").otherwise("text")), "conv_id", "turn")
