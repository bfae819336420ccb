"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .planes import token_files

    return token_files(documents(spark, sf_dir), BYTE_BPE, end_id=2)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("k2")


def op3_crf_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langcrf import languages

    docs = documents(spark, sf_dir)
    out = languages(docs, docs.where(fold("doc_id", 4) != 2))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_byte_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_copies

    return near_copies(documents(spark, sf_dir))


def op5_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeated_passages

    return repeated_passages(documents(spark, sf_dir)).drop("spans")


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxic_scores

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxic_scores(docs, labels.where(fold("doc_id", 3) != 1))
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), BYTE_BPE, end_id=1)


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matroska import media

    return media(documents(spark, sf_dir))


def op9_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bilinear import text_scores

    return text_scores(documents(spark, sf_dir), "crc32(cast(doc_id as string)) % 10 = 0")


def op10_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), PIECE_BPE, limit=4096)


def op11_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import secret_counts

    return secret_counts(documents(spark, sf_dir))


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranking import search

    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_union_find_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import alignment_counts

    return alignment_counts(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE)


def _secret_sql() -> str:
    """Positions by running lengths of gaps and matches; every window's entropy from scratch."""
    from . import secretscan as s

    quoted = lambda x: x.replace("'", "''")
    kinds = [(b.kind, b.pattern, b.group, b.least) for b in s.BASES] + [(c.kind, f"{c.pattern}{{{s.WINDOW},}}", 0, s.WINDOW) for c in s.CLASSES]
    found = " UNION ALL ".join(f"SELECT r, {i} AS k, {least} AS least, regexp_split_to_array(t, '{quoted(p)}') AS g, regexp_extract_all(t, '{quoted(p)}') AS m, regexp_extract_all(t, '{quoted(p)}', {group}) AS v FROM d" for i, (_, p, group, least) in enumerate(kinds))
    term = f"list_value({', '.join(map(str, s.terms()))})"
    limit = " ".join(f"WHEN {len(s.BASES) + i} THEN {s.bound(c.bits)}" for i, c in enumerate(s.CLASSES))
    allowed = " OR ".join(f"regexp_full_match(x, '{a}')" for a in s.ALLOWED) + " OR " + " OR ".join(f"contains('{o}', x)" for o in s.ORDERED) + f" OR x IN {s.EMPTY_DIGESTS}"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
        pos AS (SELECT r, k, least, m[i] AS x, v[i] AS v, (list_sum(list_transform(g[1:i], lambda y: len(y))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda y: len(y))), 0))::BIGINT AS a FROM f, unnest(range(1, len(m) + 1)) AS u(i)),
        w AS (SELECT r, k, a + j AS a, x[j + 1 : j + {s.WINDOW}] AS x FROM pos, unnest(range(0, len(x) - {s.WINDOW - 1})) AS u(j) WHERE k >= {len(s.BASES)} AND NOT ({allowed})),
        n AS (SELECT r, k, a, c, count(*) AS n FROM (SELECT r, k, a, unnest(string_split(x, '')) AS c FROM w) GROUP BY ALL),
        h AS (SELECT r, k, a FROM n GROUP BY r, k, a HAVING sum({term}[n + 1]) <= CASE k {limit} END),
        e AS (SELECT *, sum(o) OVER (PARTITION BY r, k ORDER BY a) AS no FROM (SELECT *, (a > coalesce(lag(a) OVER (PARTITION BY r, k ORDER BY a), -100) + {s.WINDOW})::INT AS o FROM h)),
        s AS (SELECT r, k, a, a + len(x) AS b FROM pos WHERE k < {len(s.BASES)} AND len(v) >= least UNION ALL SELECT r, k, min(a), max(a) + {s.WINDOW} FROM e GROUP BY r, k, no),
        o AS (SELECT r, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg(y, ',' ORDER BY a, k) FILTER (k < {len(s.BASES)}) AS base, string_agg(y, ',' ORDER BY a, k) AS every
            FROM (SELECT *, concat_ws(':', list_value({", ".join(repr(x[0]) for x in kinds)})[k + 1], a, b) AS y FROM s) GROUP BY r)
        SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN o USING (r)"""


QUERIES = {f.__name__: f for f in (op1_bit_planes, op2_winnowing, op3_crf_languages, op4_byte_index_simhash, op5_suffix_trees, op6_weak_supervision, op7_mixture_packing, op8_matroska, op9_log_bilinear, op10_transducer_counts, op11_entropy_secrets, op12_threshold_search, op13_union_find_alignment)}
ORACLES: dict[str, str] = {
    "op2_winnowing": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS t FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS u(p) WHERE len(w) > 0),
        lens AS (SELECT DISTINCT l FROM iw),
        dw AS (SELECT doc_id, l, p, array_to_string(w[p : p + l - 1], ' ') AS t FROM d, lens, unnest(range(1, greatest(len(w) - l + 2, 1))) AS u(p)),
        hit AS (SELECT DISTINCT doc_id, p, l, item_id FROM dw JOIN iw USING (l, t)),
        cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS k, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(k, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
        FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op5_suffix_trees": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, p, sha256(array_to_string(w[p : p + 34], ' ')) AS t FROM d, unnest(range(1, greatest(len(w) - 33, 1))) AS u(p)),
        many AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM win SEMI JOIN many USING (t))),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS s, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_entropy_secrets": _secret_sql(),
    "op12_threshold_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        q AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        b AS (SELECT i, item_id, t, count(*) AS times FROM q GROUP BY ALL),
        tot AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
        tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY ALL),
        df AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, tot GROUP BY t, nd),
        imp AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nd) // l)))) AS x FROM tf JOIN df USING (t), tot),
        s AS (SELECT i, item_id, r, doc_id, sum(times * x)::BIGINT AS score FROM imp JOIN b USING (t) GROUP BY ALL HAVING sum(times * x) > 0)
        SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r))::INT AS rank FROM s) WHERE rank <= 20""",
}
