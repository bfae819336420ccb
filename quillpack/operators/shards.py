"""Shard lists, their assignment to ranks and workers, group mixtures, and resumable positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw


def shuffled(shards: DataFrame, path: str, seed: int) -> DataFrame:
    """ord: place (from 0) of every shard in an order that the seed draws; shard lists are small enough for one window."""
    return shards.withColumn("ord", (F.row_number().over(Window.orderBy(draw(seed, "shards", path), path)) - 1).cast("long"))


def assigned(shards: DataFrame, path: str, seed: int, ranks: int, workers: int) -> DataFrame:
    """path, rank, worker, place: contiguous slices of equal size; what is over at either level is left out.

    A worker's slice is read backwards. Raises where a slice would be empty.
    """
    n = shards.count()
    per_rank = n // ranks
    per_worker = per_rank // workers
    if not per_worker:
        raise ValueError(f"{n} shards are too few for {ranks} ranks of {workers} workers")
    at = shuffled(shards.select(path), path, seed)
    within = F.col("ord") % per_rank
    out = at.where(F.col("ord") < per_rank * ranks).select(path, F.floor(F.col("ord") / per_rank).cast("int").alias("rank"), within.alias("i")).where(F.col("i") < per_worker * workers)
    return out.select(path, "rank", F.floor(F.col("i") / per_worker).cast("int").alias("worker"), (per_worker - 1 - F.col("i") % per_worker).cast("long").alias("place"))


def quota(shards: DataFrame, path: str, n: int | None) -> DataFrame:
    """The first n shards by path, repeated from the beginning if there are fewer; all of them without n."""
    if n is None:
        return shards.select(path, (F.row_number().over(Window.orderBy(path)) - 1).cast("long").alias("i"))
    count = shards.count()
    if not count:
        return shards.select(path, F.lit(0).cast("long").alias("i")).limit(0)
    order = shards.select(path, (F.row_number().over(Window.orderBy(path)) - 1).cast("long").alias("k"))
    return shards.sparkSession.range(n).select(F.col("id").alias("i"), (F.col("id") % count).alias("k")).join(order, "k").select(path, "i")


def intervals(groups: DataFrame, name: str, weight: str) -> DataFrame:
    """Each group's interval [low, high) of cumulative probability, in order of name; the sum of weights must be positive."""
    w = Window.orderBy(name)
    total = F.sum(weight).over(Window.partitionBy())
    high = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total
    return groups.select(name, weight, high.alias("high")).withColumn("low", F.coalesce(F.lag("high").over(w), F.lit(0.0)))


def picked(rows: DataFrame, weights: dict[str, float], seed: int, *keys: Column | str) -> Column:
    """The group of each row: the first whose cumulative probability exceeds a draw. The groups are configuration."""
    if sum(weights.values()) <= 0:
        raise ValueError("weights must sum to more than 0")
    u, total, cum, out = draw(seed, "mixture", *keys), sum(weights.values()), 0.0, None
    for name, w in weights.items():
        cum += w
        cond = u < F.lit(cum / total)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(list(weights)[-1]))


def after(rows: DataFrame, saved: tuple[int, ...], *position: str) -> DataFrame:
    """Rows behind a saved position; positions compare from left to right. The first part alone is said again, for the scan to skip by."""
    return rows.where(F.col(position[0]) >= saved[0]).where(F.struct(*position) > F.struct(*(F.lit(x).cast("long").alias(p) for x, p in zip(saved, position, strict=True))))


def offsets(rows: DataFrame, keys: list[str], consumed: str, *position: str) -> DataFrame:
    """The position consumed last for each key: by order of consumption, which isn't that of reading."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*position), F.col(consumed)).alias("at")).select(*keys, "at.*")


def latest(names: DataFrame, name: str) -> DataFrame:
    """The checkpoint directory of the greatest number."""
    return names.where(F.col(name).rlike(r"^\d+$")).agg(F.max_by(name, F.col(name).cast("long")).alias(name))


def epochs(rows: DataFrame, n: int, first: int = 0) -> DataFrame:
    """n passes over the same rows in the same order; epoch counts from `first`."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))


def remaining(packs: DataFrame, step: str, done: int, total: int) -> DataFrame:
    """The packs of the steps that are left: at most total - done, from the first."""
    return packs.where(F.col(step) < max(total - done, 0))


def step_rates(log: DataFrame, keys: list[str], step: str, seconds: str) -> DataFrame:
    """keys, step, rate: steps a second since the log entry before; null on the first."""
    w = Window.partitionBy(*keys).orderBy(step)
    return log.select(*keys, step, ((F.col(step) - F.lag(step).over(w)) / F.nullif(F.col(seconds) - F.lag(seconds).over(w), F.lit(0.0))).alias("rate"))
