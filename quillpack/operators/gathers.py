"""Positional joins: scatter, gather, un-padding, beams, key sets, pooling, span losses, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scattered(rows: DataFrame, updates: DataFrame, keys: list[str], value: str, order: str | None = None) -> DataFrame:
    """rows with value replaced where updates has the key; of several updates the last by order wins."""
    if order:
        updates = updates.groupBy(*keys).agg(F.max_by(value, order).alias(value))
    new = updates.select(*keys, F.col(value).alias("new_"), F.lit(True).alias("hit_"))
    return rows.join(new, keys, "left").withColumn(value, F.when(F.col("hit_"), F.col("new_")).otherwise(F.col(value))).drop("new_", "hit_")


def gathered(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of a table looked up by id; Spark broadcasts the table if it is small enough."""
    return ids.join(table, key, "left")


def unpadded(rows: DataFrame, seq: str, pos: str, mask: Column) -> DataFrame:
    """Rows whose mask is set, with their place among them (from 0), in order of sequence and position."""
    w = Window.partitionBy(seq).orderBy(pos)
    return rows.where(mask).withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def reordered(beams: DataFrame, order: DataFrame, beam: str, place: str) -> DataFrame:
    """State rows by beam, taken by each place of a new order (place, beam)."""
    return order.join(beams, beam)


def key_difference(have: DataFrame, want: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(loaded, unexpected, missing) keys."""
    return have.select(key).intersect(want.select(key)), have.select(key).exceptAll(want.select(key)), want.select(key).exceptAll(have.select(key))


def last_before_pad(rows: DataFrame, seq: str, pos: str, token: str, pad: int) -> DataFrame:
    """seq, pos of the row in front of the first pad, modulo the length; the last row without a pad."""
    first = F.min(F.when(F.col(token) == pad, F.col(pos)))
    return rows.groupBy(seq).agg(first.alias("f"), F.count("*").alias("n")).select(seq, F.when(F.col("f").isNull(), F.col("n") - 1).otherwise(F.pmod(F.col("f") - 1, F.col("n"))).cast("long").alias(pos))


def span_labels(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """Span ends within 0..length; the length itself means ignored (null)."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(0)), length)
    return F.when(clamp(start) < length, clamp(start)), F.when(clamp(end) < length, clamp(end))


def padded_size(images: DataFrame, pack: str, height: str, width: str) -> DataFrame:
    """pack, height, width that all its images fit in, by axis."""
    return images.groupBy(pack).agg(F.max(height).alias(height), F.max(width).alias(width))


def regrouped(splits: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """Which sample (key, sample_ord, length) each split (key, split_ord, len) of a flat list belongs to, by running lengths.

    Both sides of a pack are brought into one ordered run of ends: a sample's end closes it, so one window gives what a range join would.
    """
    w = lambda o: Window.partitionBy(key).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    s = splits.select(key, F.sum("len").over(w("split_ord")).alias("end"), F.lit(0).alias("kind"), "split_ord", "len", F.lit(None).cast("int").alias("sample_ord"))
    t = samples.select(key, F.sum("length").over(w("sample_ord")).alias("end"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("split_ord"), F.lit(None).cast("long").alias("len"), "sample_ord")
    ahead = Window.partitionBy(key).orderBy("end", "kind").rowsBetween(0, Window.unboundedFollowing)
    return s.unionByName(t).withColumn("sample_ord", F.first("sample_ord", ignorenulls=True).over(ahead)).where("kind = 0").select(key, "split_ord", "len", "sample_ord")


def doubled(tokens: DataFrame, pos: str, length: int) -> DataFrame:
    """Conditional and unconditional copies of tokens: branch, and positions of the second behind the first."""
    return tokens.withColumn("branch", F.lit(0)).unionByName(tokens.withColumn(pos, F.col(pos) + length).withColumn("branch", F.lit(1)))


def last_rows(rows: DataFrame, seq: str, pos: str, value: str) -> DataFrame:
    """seq, value of each sequence's last row, which an end mark that stays last makes the pooled one."""
    return rows.groupBy(seq).agg(F.max_by(value, pos).alias(value))


def span_loss(rows: DataFrame, start: Column, end: Column, length: Column, start_loss: Column, end_loss: Column) -> DataFrame:
    """Mean of the two ends' mean losses; an end out of 0..length - 1 counts for nothing."""
    a, b = span_labels(start, end, length)
    return rows.agg(((F.avg(F.when(a.isNotNull(), start_loss)) + F.avg(F.when(b.isNotNull(), end_loss))) / 2).alias("loss"))
