"""Masking of targets, and the lengths that they are trained at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import chosen_split, chunks, padded_length, split_counts
from ..functions.draws import draw, draw_int, draw_normal

def mask_probability(seed: int, *keys: Column | str, eps: float = 1e-3) -> Column:
    return (1.0 - eps) * draw(seed, "mask/t", *keys) + eps


#: Attempts that are written into a plan one by one; behind them the draws go on in a loop.
ATTEMPTS = 3


def _attempt(n: Column, seed: int, a: Column, keys: tuple) -> Column:
    p = mask_probability(seed, a, *keys)
    return F.struct(p.alias("p"), F.filter(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: draw(seed, "mask/u", a, *keys, i) < p).alias("positions"))


def masked_positions(n: Column, seed: int, *keys: Column | str) -> Column:
    """struct(p, positions): each position of n with probability p, both drawn anew until a position is hit; n is at least 1.

    An attempt is made only where those before it failed, and its draws once. It succeeds with a probability over 0.4 whatever n
    is, so that 2000 more attempts all fail in one of 10**400 rows, and these get no position.
    """
    none = F.struct(F.lit(0.0).alias("p"), F.expr("array()").cast("array<bigint>").alias("positions"))
    hit = lambda t: F.size(t["positions"]) > 0
    # a fold over the numbers of attempts keeps what it has once that is a hit
    fold = lambda numbers, begin: F.aggregate(numbers, begin, lambda t, a: F.when(hit(t), t).otherwise(_attempt(n, seed, a, keys)))
    first = fold(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), none)
    return F.aggregate(F.array(F.lit(0)), first, lambda t, _: F.when(hit(t), t).otherwise(fold(F.sequence(F.lit(ATTEMPTS), F.lit(ATTEMPTS + 2000)), t)))


def with_last(positions: Column, n: Column) -> Column:
    """Masked positions with the last one of n among them."""
    return F.array_union(positions, F.when(n > 0, F.array((n - 1).cast("long"))).otherwise(F.expr("array()").cast("array<bigint>")))


def timesteps(items: DataFrame, keys: list[str], split: str, clean: Column, seed: int) -> DataFrame:
    """items with timestep: one normal draw a split, shared by all of its rows; minus infinity where the row is clean."""
    return items.withColumn("timestep", F.when(clean, F.lit(float("-inf"))).otherwise(draw_normal(seed, "timestep", *keys, split)))


def adapted_length(n: Column, seed: int, *keys: Column | str) -> Column:
    """Length (end mark included): a tenth of the texts are lengthened by 1..n, a tenth of those over 16 are cut to 1..n-1."""
    u = draw(seed, "adapt", *keys)
    return F.when(u < 0.1, n + draw_int(1, n, seed, "adapt/add", *keys)).when((u < 0.2) & (n > 16), draw_int(1, n - 1, seed, "adapt/cut", *keys)).otherwise(n).cast("long")


def split_lengths(rows: DataFrame, n: str, seed: int, *keys: str) -> DataFrame:
    """rows with full, count, chunks: a text of n, a fifth of them filled up first, in `count` chunks, drawn with weights of 1 / 2K."""
    full = F.when(draw(seed, "fill", *keys) < 0.2, padded_length(F.col(n) + 1)).otherwise(F.col(n) + 1).cast("long")
    rows = rows.withColumn("full", full).withColumn("counts", split_counts(F.col("full"))).withColumn("u", draw(seed, "split", *keys))
    rows = rows.withColumn("count", chosen_split(F.col("counts"), F.col("u"))).drop("counts", "u")
    return rows.withColumn("chunks", chunks(F.col("full"), F.col("count")))


def end_targets(n: Column, rounds: Column, seed: int, *keys: Column | str) -> Column:
    """End marks added to an answer of n: 0..n for 15 of 100 single-round and 10 of 100 other answers."""
    share = F.when(rounds == 1, F.lit(0.15)).otherwise(F.lit(0.10))
    return F.when(draw(seed, "ends", *keys) < share, draw_int(0, n, seed, "ends/n", *keys)).otherwise(F.lit(0)).cast("long")
