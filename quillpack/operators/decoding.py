"""Which masked positions a decoding step reveals. Rows are (sequence, position, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw


def ranked(rows: DataFrame, seq: str, pos: str, confidence: str) -> Column:
    return F.row_number().over(Window.partitionBy(seq).orderBy(F.desc(confidence), F.asc(pos)))


def top_transfers(rows: DataFrame, seq: str, pos: str, confidence: str, k: Column | int) -> DataFrame:
    """The k surest positions of each sequence; the first of equals."""
    return rows.withColumn("rank_", ranked(rows, seq, pos, confidence)).where(F.col("rank_") <= k).drop("rank_")


def threshold_transfers(rows: DataFrame, seq: str, pos: str, confidence: str, least: float) -> DataFrame:
    """All positions of at least this confidence; where a sequence has none, its surest."""
    r = rows.withColumn("rank_", ranked(rows, seq, pos, confidence))
    # the surest tells whether any is sure enough
    return r.where((F.col(confidence) >= least) | (F.col("rank_") == 1)).drop("rank_")


def argmax(rows: DataFrame, keys: list[str], token: str, logit: str) -> DataFrame:
    """The token of the greatest logit, the least of equals. Partial maxima before the shuffle."""
    return rows.groupBy(*keys).agg(F.max(F.struct(F.col(logit).alias("l"), (-F.col(token)).alias("t"))).alias("m")).select(*keys, (-F.col("m.t")).alias(token), F.col("m.l").alias(logit))


def confidences(rows: DataFrame, keys: list[str], token: str, logit: str) -> DataFrame:
    """keys, token, p: softmax of the logits of each position."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    return rows.select(*keys, token, e.alias("e")).select(*keys, token, (F.col("e") / F.sum("e").over(w)).alias("p"))


def token_counts(rows: DataFrame, seq: str, pos: str, token: str, end: int) -> DataFrame:
    """seq, valid, total: tokens up to the first end mark, itself included, and all."""
    first = F.min(F.when(F.col(token) == end, F.col(pos)))
    return rows.groupBy(seq).agg(F.coalesce(first + 1, F.count("*")).cast("long").alias("valid"), F.count("*").alias("total"))


def drawn_confidence(seed: int, *keys: Column | str) -> Column:
    """Confidences that know nothing of the logits: positions are then revealed in a drawn order."""
    return draw(seed, "remask", *keys)
