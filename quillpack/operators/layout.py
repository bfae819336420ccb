"""Splits of packed samples: lengths, attention modes, token and rope positions, and which pairs may attend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: length, attention mode, rope step of a split
SPLIT = "struct<len:bigint,mode:string,rope:bigint>"


def _split(length: Column, mode: str, rope: Column) -> Column:
    return F.struct(length.cast("long").alias("len"), F.lit(mode).alias("mode"), rope.cast("long").alias("rope"))


def text_splits(n: Column, loss: Column, rounds: Column, padded: Column | None = None) -> Column:
    """Splits of a text of n tokens: given text is one full split of n + 2; a single-round answer is one noise split; an
    answer among several rounds is a noise split and a clean copy, both from the same rope position."""
    target = n if padded is None else padded
    given = F.array(_split(n + 2, "full", n + 2))
    single = F.array(_split(target + 1, "noise", target + 1))
    several = F.array(_split(target + 1, "noise", F.lit(0)), _split(n + 2, "full", n + 2))
    return F.when(loss == 0, given).when(rounds == 1, single).otherwise(several)


def image_splits(n: Column, kind: str, loss: Column) -> Column:
    """n patches and two marks: looked-at and conditioning images step the rope by one, targets by none."""
    if kind == "vit":
        return F.array(_split(n + 2, "full", F.lit(1)))
    return F.when(loss == 1, F.array(_split(n + 2, "noise", F.lit(0)))).otherwise(F.array(_split(n + 2, "full", F.lit(1))))


def segments(items: DataFrame, keys: list[str], order: str, splits: str = "splits") -> DataFrame:
    """keys, split_ord, len, mode, start, rope: prefix sums of the splits of each sample in order. One shuffle, on keys."""
    flat = items.select(*keys, order, F.posexplode(splits).alias("k", "s"))
    w = Window.partitionBy(*keys).orderBy(order, "k")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return flat.select(
        *keys, (F.row_number().over(w) - 1).cast("int").alias("split_ord"), F.col("s.len").alias("len"), F.col("s.mode").alias("mode"),
        F.coalesce(F.sum("s.len").over(before), F.lit(0)).cast("long").alias("start"), F.coalesce(F.sum("s.rope").over(before), F.lit(0)).cast("long").alias("rope"),
    )


def pair_counts(segs: DataFrame, keys: list[str]) -> DataFrame:
    """Allowed (query, key) token pairs of every split, without the pairs: earlier splits are seen whole unless they are noise,
    a split sees itself whole, or, if causal, up to each token. A prefix sum, no join."""
    w = Window.partitionBy(*keys).orderBy("split_ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.when(F.col("mode") != "noise", F.col("len")).otherwise(0)).over(w), F.lit(0))
    own = F.when(F.col("mode") == "causal", (F.col("len") * (F.col("len") + 1) / 2).cast("long")).otherwise(F.col("len") * F.col("len"))
    return segs.select(*keys, "split_ord", (F.col("len") * seen + own).cast("long").alias("pairs"))


def tokens(segs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, split_ord, mode: one row a token."""
    return segs.select(*keys, "split_ord", "mode", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos"))


def may_attend(q_pos: Column, k_pos: Column, q_split: Column, k_split: Column, q_mode: Column, k_mode: Column) -> Column:
    """The predicate on two tokens of one sample."""
    same = q_split == k_split
    return ((q_pos >= k_pos) | (same & q_mode.isin("full", "noise"))) & ~((k_mode == "noise") & ~same)


def tokens_seen(segs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, split_ord, pos, seen: how many tokens each token sees (may_attend), without the pairs. Running sums over splits, then a row a token."""
    w = Window.partitionBy(*keys).orderBy("split_ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("mode") != "noise", F.col("len")).otherwise(0)).over(w), F.lit(0))
    rows = segs.select(*keys, "split_ord", "mode", "start", "len", before.alias("before_")).where("len > 0")
    rows = rows.select("*", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos"))
    own = F.when(F.col("mode").isin("full", "noise"), F.col("len")).otherwise(F.col("pos") - F.col("start") + 1)
    return rows.select(*keys, "split_ord", "pos", (F.col("before_") + own).cast("long").alias("seen"))


def mask_rows(segs: DataFrame, keys: list[str], of: Callable[[Column], Column]) -> DataFrame:
    """keys, pos, seen: `of` the ordered positions that each token sees (may_attend), without the pairs.

    All tokens of a split that sees itself whole have one row of the mask, which is worked out once a split; a causal split's once a token.
    A task holds the splits of a sample, and one row of the mask.
    """
    upto = lambda a, b: F.sequence(a, b)
    splits = F.array_sort(F.collect_list(F.struct("split_ord", "start", "len", "mode")))
    rows = segs.where("len > 0").groupBy(*keys).agg(splits.alias("s_")).select(*keys, "s_", F.explode("s_").alias("q_"))
    earlier = F.filter("s_", lambda k: (k["split_ord"] < F.col("q_.split_ord")) & (k["mode"] != "noise"))
    before = F.flatten(F.transform(earlier, lambda k: upto(k["start"], k["start"] + k["len"] - 1)))
    first, last = F.col("q_.start"), F.col("q_.start") + F.col("q_.len") - 1
    row = lambda b, a, z: F.struct(a.alias("a"), z.alias("z"), of(F.concat(b, upto(first, z))).alias("seen"))
    each = F.transform(F.array(before), lambda b: F.when(F.col("q_.mode").isin("full", "noise"), F.array(row(b, first, last))).otherwise(F.transform(upto(first, last), lambda p: row(b, p, p))))
    rows = rows.select(*keys, F.explode(F.flatten(each)).alias("r_"))
    return rows.select(*keys, F.explode(upto(F.col("r_.a"), F.col("r_.z"))).alias("pos"), F.col("r_.seen").alias("seen"))


def positions_of_mask(mask: Column) -> Column:
    """Position ids of a 0/1 padding mask: running sum less one; 1 where padded."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.expr("array()").cast("array<bigint>").alias("ids"))
    return F.aggregate(mask, start, lambda a, m: F.struct((a["n"] + m).alias("n"), F.concat(a["ids"], F.array(F.when(m == 0, F.lit(1).cast("long")).otherwise(a["n"] + m - 1))).alias("ids")))["ids"]


def context_events(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, order, kind, kv, rope: cache and rope lengths behind each event (kind, n) of a context.

    Text adds n + 2 to both, an image n + 2 and 1, a generated block n to both.
    """
    kv = F.when(F.col("kind") == "block", F.col("n")).otherwise(F.col("n") + 2)
    rope = F.when(F.col("kind") == "image", F.lit(1)).when(F.col("kind") == "block", F.col("n")).otherwise(F.col("n") + 2)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.select(*keys, order, "kind", F.sum(kv).over(w).cast("long").alias("kv"), F.sum(rope).over(w).cast("long").alias("rope"))


def frame_deltas(frames: DataFrame, keys: list[str], index: str) -> DataFrame:
    """keys, index, delta to the next frame (null on the last), is_first, is_last."""
    w = Window.partitionBy(*keys).orderBy(index)
    return frames.select(*keys, index, (F.lead(index).over(w) - F.col(index)).alias("delta"), F.lag(index).over(w).isNull().alias("is_first"), F.lead(index).over(w).isNull().alias("is_last"))


def request_contexts(events: DataFrame, key: str, order: str) -> DataFrame:
    """key, and cache and rope lengths of a request's three contexts, from its ordered texts and images (kind, n).

    Full: all of them. Without text: as it was in front of the latest text, or behind an image that follows it. Without images: the
    texts alone. One shuffle.
    """
    rope = F.when(F.col("kind") == "image", F.lit(1)).otherwise(F.col("n") + 2)
    last = F.max(order).over(Window.partitionBy(key)) == F.col(order)
    rows = events.select(key, (F.col("n") + 2).alias("kv"), rope.alias("rope"), (F.col("kind") == "text").alias("is_text"), (last & (F.col("kind") == "text")).alias("newest"))
    total = lambda c, keep: F.sum(F.when(keep, F.col(c)).otherwise(0)).cast("long")
    every = F.lit(True)
    return rows.groupBy(key).agg(
        total("kv", every).alias("kv"), total("rope", every).alias("rope"), total("kv", ~F.col("newest")).alias("kv_no_text"), total("rope", ~F.col("newest")).alias("rope_no_text"),
        total("kv", F.col("is_text")).alias("kv_no_image"), total("rope", F.col("is_text")).alias("rope_no_image"),
    )


def mask_blocks(samples: DataFrame, keys: list[str], mask: str, causal: Column, block: int = 128) -> DataFrame:
    """keys, q_block, k_block, pairs, whole: the blocks of a sample's attention mask in which some pair may attend, and how many do.

    mask: 1 for every token that may be seen, 0 for padding (which still looks around). causal: whether tokens see up to themselves only. A block is whole
    if all of its pairs may. Pairs are counted from running sums of the mask: no pair of tokens is made, only a row for each pair of blocks.
    """
    n = F.size("m_")
    zero = F.array(F.lit(0).cast("long"))
    rows = samples.select(*keys, F.col(mask).alias("m_"), causal.alias("c_")).where(n > 0)
    # sums inside of blocks, then over blocks: linear in a sample's length
    blocks = F.transform(F.sequence(F.lit(0), n - 1, F.lit(block)), lambda b: F.slice("m_", b + 1, block))
    inner = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))))
    rows = rows.select(*keys, "c_", n.alias("n_"), inner.alias("s_"))
    rows = rows.select(*keys, "c_", "n_", F.explode(F.transform("s_", lambda s, k: F.struct(k.alias("k_block"), s.alias("s")))).alias("b"), F.size("s_").alias("count_"))
    rows = rows.select(*keys, "c_", "n_", "b.k_block", "b.s", F.explode(F.sequence(F.when(F.col("c_"), F.col("b.k_block")).otherwise(0), F.col("count_") - 1)).alias("q_block"))
    queries = F.least(F.lit(block), F.col("n_") - F.col("q_block") * block)
    tokens = F.size("s") - 1
    seen = F.element_at("s", -1)
    # on the diagonal a causal query sees as far as itself
    own = F.aggregate(F.slice("s", F.lit(2), tokens), F.lit(0).cast("long"), lambda a, x: a + x)
    pairs = F.when(F.col("c_") & (F.col("q_block") == F.col("k_block")), own).otherwise(queries * seen)
    return rows.select(*keys, "q_block", "k_block", pairs.cast("long").alias("pairs"), (pairs == queries * tokens).alias("whole")).where("pairs > 0")
