"""Losses and metrics over tokens, ranks and images; all by partial aggregates."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import sigmoid


def cross_entropy(rows: DataFrame, loss: str, weight: str | None = None) -> DataFrame:
    """Global mean over tokens, or the weighted mean."""
    if weight:
        return rows.agg((F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)).alias("ce"))
    return rows.agg((F.sum(loss) / F.count(loss)).alias("ce"))


def squared_error(rows: DataFrame, per_token: Column) -> DataFrame:
    """Mean over tokens of each token's mean over dimensions."""
    return rows.agg((F.sum(per_token) / F.count(F.lit(1))).alias("mse"))


def mean_of_means(rows: DataFrame, group: str, value: Column) -> DataFrame:
    return rows.groupBy(group).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"))


def combined(terms: dict[str, float]) -> Column:
    out = None
    for name, w in terms.items():
        out = F.col(name) * w if out is None else out + F.col(name) * w
    return out


#: Query vectors in a block, which a task holds, and vectors in a chunk that pass by it; pairs that are worked out at a time.
BLOCK, TILE = 8192, 1 << 18


def _vectors(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as rows, filled up with zeros, their lengths); a length of -1 where a vector or one of its numbers is null."""
    n = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype("i8")
    flat = x.flatten().cast(pa.float64())
    out = np.zeros((len(n), int(n.max(initial=0))))
    at = np.arange(out.shape[1]) < n[:, None]
    out[at] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    gone = np.zeros(out.shape, bool)
    gone[at] = flat.is_null().to_numpy(zero_copy_only=False)
    return out, np.where(gone.any(1) | x.is_null().to_numpy(zero_copy_only=False), -1, n)


def _cosines(rows: DataFrame, queries: DataFrame, key: str, vector: str, of: Callable[..., pa.RecordBatch], ddl: str) -> DataFrame:
    """of(query keys, keys, cosines as a matrix, where they are null) for some queries and some rows at a time, each pair in one of them.

    Queries are dealt to blocks and rows to chunks of about BLOCK vectors by their keys; a block and a chunk meet in a task of their own, where
    the chunk passes by the block in batches: a task holds a block and a batch, whatever the number of pairs, which are matrix products.
    """
    blocks, chunks = (max(1, -(-df.count() // BLOCK)) for df in (queries, rows))
    to = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = queries.select(to(blocks).alias("i_"), every(chunks).alias("j_"), F.lit(0).alias("side_"), F.col(key).alias("key_"), F.col(vector).alias("vector_"))
    passing = rows.select(every(blocks).alias("i_"), to(chunks).alias("j_"), F.lit(1).alias("side_"), F.col(key).alias("key_"), F.col(vector).alias("vector_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, block = None, [], None
        for batch in batches:
            at = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            cut = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)] if len(at) else [0]
            for a, b in itertools.pairwise(cut):
                own = batch.slice(a, b - a)
                if cell != tuple(at[a, :2]):
                    cell, parts, block = tuple(at[a, :2]), [], None
                if at[a, 2] == 0:
                    parts.append((own.column(3), own.column(4)))
                    continue
                if not parts:
                    continue
                if block is None:
                    vectors, lengths = _vectors(pa.concat_arrays([v for _, v in parts]))
                    block = pa.concat_arrays([k for k, _ in parts]), vectors, lengths, np.sqrt((vectors * vectors).sum(1))
                names, q, q_lengths, q_norms = block
                v, lengths = _vectors(own.column(4))
                norms = np.sqrt((v * v).sum(1))
                width, step = min(q.shape[1], v.shape[1]), max(1, TILE // len(q))
                for r in range(0, len(v), step):
                    to_r = slice(r, r + step)
                    null = (lengths[to_r, None] != q_lengths) | (lengths[to_r, None] < 0)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        cosine = (v[to_r, :width] @ q[:, :width].T) / (norms[to_r, None] * q_norms)
                    yield of(names, own.column(3)[to_r], cosine, null)

    dealt = held.unionByName(passing).repartition(blocks * chunks, "i_", "j_").sortWithinPartitions("i_", "j_", "side_")
    return dealt.mapInArrow(run, ddl)


def cosine_to_queries(rows: DataFrame, queries: DataFrame, key: str, vector: str) -> DataFrame:
    """q, key, cosine of every row with a stated set of queries; null where a vector or one of its numbers is, or lengths differ, and NaN without a norm."""
    kind = rows.schema[key].dataType.simpleString()

    def of(names: pa.Array, keys: pa.Array, cosine: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
        n, m = cosine.shape
        q, k = names.take(pa.array(np.tile(np.arange(m), n))), keys.take(pa.array(np.repeat(np.arange(n), m)))
        return pa.RecordBatch.from_arrays([q, k, pa.array(cosine.ravel(), mask=null.ravel() if null.any() else None)], names=["q", key, "cosine"])

    return _cosines(rows, queries, key, vector, of, f"q {kind}, `{key}` {kind}, cosine double")


def sigmoid_loss_to_queries(rows: DataFrame, queries: DataFrame, key: str, vector: str, scale: float, shift: float) -> DataFrame:
    """sigmoid_loss of the pairs of cosine_to_queries with logits scale * cosine + shift. A query's sums leave the task, no pair does."""
    kind = rows.schema[key].dataType.simpleString()

    def of(names: pa.Array, keys: pa.Array, cosine: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
        known = pc.unique(names)
        q, k = (pc.fill_null(pc.index_in(x, value_set=known, skip_nulls=True), -1 - i).to_numpy(zero_copy_only=False) for i, x in enumerate((names, keys)))
        logit = scale * cosine + shift
        terms = np.logaddexp(0.0, np.where(k[:, None] == q, -logit, logit))
        return pa.RecordBatch.from_arrays([names, pa.array(np.where(null, 0.0, terms).sum(0), mask=null.all(0))], names=["q", "s"])

    sums = _cosines(rows, queries, key, vector, of, f"q {kind}, s double")
    return sums.groupBy("q").agg(F.sum("s").alias("s")).agg(F.avg("s").alias("loss"))


def sigmoid_loss(pairs: DataFrame, q: str, key: str, logit: Column) -> DataFrame:
    """Mean over queries of the sum over keys of -log sigmoid(logit if matched, else -logit)."""
    signed = F.when(F.col(q) == F.col(key), logit).otherwise(-logit)
    return pairs.groupBy(q).agg(F.sum(-F.log(sigmoid(signed))).alias("s")).agg(F.avg("s").alias("loss"))


def next_token_loss(rows: DataFrame, seq: str, pos: str, nll_of_label: Column) -> DataFrame:
    """Mean of a loss between each position's prediction and the next position's label; the last position has none."""
    from pyspark.sql import Window

    last = F.lead(pos).over(Window.partitionBy(seq).orderBy(pos)).isNull()
    return rows.withColumn("last_", last).where(~F.col("last_")).agg(F.avg(nll_of_label).alias("loss"))


def shifted_cross_entropy(logits: DataFrame, labels: DataFrame, seq: str = "seq", pos: str = "pos", ignored: int = -100) -> DataFrame:
    """loss, n: the mean, over n positions, of the cross entropy between a position's logits (seq, pos, k, x) and the label of the next one.

    Positions of a sequence follow each other by pos; the last one, and those whose next label is `ignored`, count for nothing; without any,
    loss is null. A position's logits are reduced to their maximum, then to a sum of exponentials under it, by partial aggregates, and never gathered.
    """
    from pyspark.sql import Window

    following = F.lead("label").over(Window.partitionBy(seq).orderBy(pos))
    targets = labels.select(seq, pos, following.alias("label")).where(F.col("label").isNotNull() & (F.col("label") != ignored))
    most = logits.groupBy(seq, pos).agg(F.max("x").alias("most"))
    met = logits.join(targets.join(most, [seq, pos]), [seq, pos])
    sums = met.groupBy(seq, pos, "most").agg(F.sum(F.exp(F.col("x") - F.col("most"))).alias("s"), F.max(F.when(F.col("k") == F.col("label"), F.col("x"))).alias("hit"))
    return sums.agg(F.avg(F.col("most") + F.log("s") - F.col("hit")).alias("loss"), F.count("*").alias("n"))


def mean_pooled(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """group, dim, value: mean of the vectors by dimension."""
    return rows.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))
