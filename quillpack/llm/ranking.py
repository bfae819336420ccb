"""Ranked lexical search by a threshold-seeded join.

Every text of a query is a bag of terms; a document's score is the sum, over them, of impacts worked out in whole numbers. Of every term the
documents with its TOP highest impacts are stored: the last of these impacts is the term's kth impact, the first its bound. Then:

1. Seeds. A query's kth score is at least the kth impact of any of its terms, times the term's number there. The stored documents of
   its terms are scored exactly, and the kth of these scores, where there are so many, is a higher lower bound: the threshold.
2. Pruning. A query's terms are ordered by their bounds; those at the small end whose bounds sum to less than a share (SUFFIX) of the
   threshold can't lift a document over it alone. Only the postings of the other terms make candidates. With a share of 1 all that
   would be safe is pruned, but then hardly a candidate falls in the next step; with a half, few are left.
3. Candidates. Partial scores over those terms; a candidate whose partial score with the suffix's bound stays under the threshold goes.
4. The rest is scored exactly over all terms, and the first TOP by score, then doc_id, stay.

A document with the kth score or more is never lost: ties with the threshold pass every test. Documents are read once; a text's terms are
counted within its row (sorted, equal neighbours counted), so postings need no shuffle, and only terms of some query are kept. Everything that grows
with a term's documents is a partial aggregate or a top-k cut inside of tasks first. The queries' side is broadcast by
Spark where its size allows, else joins shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

TOP = 20
#: The suffix's share of the threshold; any from 0 to 1 gives the same result.
SUFFIX = 0.5
NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, NOT_TERM, -1), "")


def bags(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, n (all terms), term, tf: one row a distinct term of a row, and one with an empty term for the row itself; no shuffle."""
    # filter(f) with an index gives the places at which a run of equal terms begins
    sorted_terms = rows.select(*keys, F.array_sort(terms(F.col(text))).alias("t"))
    begins = F.filter(F.transform("t", lambda x, i: F.when((i == 0) | (x != F.get("t", i - 1)), i)), lambda i: i.isNotNull())
    at = sorted_terms.select(*keys, F.size("t").cast("long").alias("n"), "t", begins.alias("b"))
    runs = F.transform("b", lambda i, j: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("b", j + 1), F.col("n")) - i).cast("long").alias("tf")))
    own = F.array(F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")))
    return at.select(*keys, "n", F.explode(F.concat(own, runs)).alias("x")).select(*keys, "n", "x.term", "x.tf")


def _first(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of every value of `by`, and their number rank from 1; tasks cut their own rows before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def _scores(pairs: DataFrame, postings: DataFrame, asked: DataFrame) -> DataFrame:
    """query, row, doc_id, score of pairs (query, row), over all terms of the query."""
    met = postings.select("row", "doc_id", "term_id", "impact").join(pairs.select("query", "row"), "row").join(asked.select("query", "term_id", "times"), ["query", "term_id"])
    return met.groupBy("query", "row", "doc_id").agg(F.sum(F.col("times") * F.col("impact")).alias("score"))


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, query_id: str = "item_id") -> DataFrame:
    """query_id, rank, doc_id, score: the k highest-scoring documents of each row of queries, with a score above 0.

    A null text has no term: it is not counted among documents, is in no result, and as a query finds nothing. Equal scores are
    ranked by doc_id, a null doc_id last; repeated rows of documents are documents each, and repeated queries have results each. Empty tables give none.
    """
    asked = materialise(bags(queries.select(F.monotonically_increasing_id().alias("query"), F.col(query_id).alias("named"), "text"), "text", "query", "named").where("term <> ''"), "queries")
    # the empty term stands for the document itself; from a written table Spark knows whether the vocabulary can be broadcast
    own = asked.sparkSession.range(1).select(F.lit("").alias("term"))
    vocabulary = materialise(asked.select("term").distinct().union(own).select("term", F.when(F.col("term") == "", -1).otherwise(F.monotonically_increasing_id()).alias("term_id")), "vocabulary")
    asked = materialise(asked.join(vocabulary, "term").select("query", "named", "term_id", F.col("tf").alias("times")), "asked")
    rows = bags(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "text", "row", "doc_id")
    counted = materialise(rows.where("n > 0").join(vocabulary, "term").select("row", "doc_id", "n", "term_id", "tf"), "postings")
    total = counted.where("term_id = -1").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    n_docs, length = F.lit(total["docs"]).cast("long"), F.lit(max(total["length"], 1)).cast("long")
    df = counted.where("term_id >= 0").groupBy("term_id").agg(F.count("*").alias("df"))
    weights = materialise(df.select("term_id", F.floor(1000 * F.ln((2 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")), "weights")
    m = F.lit(75).cast("long") + F.call_function("div", F.lit(25).cast("long") * F.col("n") * n_docs, length)
    impact = F.col("w") * F.call_function("div", F.lit(1_000_000_000).cast("long") * F.col("tf"), 1000 * F.col("tf") + 12 * m)
    postings = counted.join(weights, "term_id").select("row", "doc_id", "term_id", impact.alias("impact"))

    stored = materialise(_first(postings.select("term_id", "row", "impact"), "term_id", k, F.desc("impact"), F.col("row")), "stored")
    bounds = stored.groupBy("term_id").agg(F.max("impact").alias("bound"), F.max(F.when(F.col("rank") == k, F.col("impact"))).alias("kth"))
    asked_bounds = materialise(asked.join(bounds, "term_id").select("query", "term_id", "times", (F.col("times") * F.col("bound")).alias("bound"), (F.col("times") * F.coalesce("kth", F.lit(0))).alias("kth")), "bounds")

    seeds = materialise(_scores(stored.join(asked.select("query", "term_id"), "term_id").select("query", "row").distinct(), postings, asked), "seeds")
    kth = _first(seeds, "query", k, F.desc("score"), F.col("row")).where(F.col("rank") == k).select("query", F.col("score").alias("seeded"))
    threshold = asked_bounds.groupBy("query").agg(F.max("kth").alias("kth")).join(kth, "query", "left").select("query", F.greatest("kth", F.coalesce("seeded", F.lit(0)), F.lit(1)).alias("threshold"))
    suffix = F.sum("bound").over(Window.partitionBy("query").orderBy("bound", "term_id").rowsBetween(Window.unboundedPreceding, 0))
    pruned = materialise(asked_bounds.withColumn("suffix", suffix).join(threshold, "query").withColumn("out", F.col("suffix") < SUFFIX * F.col("threshold")), "pruned")
    rest = pruned.groupBy("query").agg(F.first("threshold").alias("threshold"), F.coalesce(F.sum(F.when(F.col("out"), F.col("bound"))), F.lit(0)).alias("rest"))
    partial = postings.join(pruned.where(~F.col("out")).select("query", "term_id", "times"), "term_id").groupBy("query", "row").agg(F.sum(F.col("times") * F.col("impact")).alias("part"))
    candidates = materialise(partial.join(rest, "query").where(F.col("part") + F.col("rest") >= F.col("threshold")).select("query", "row"), "candidates")
    named = asked.select("query", F.col("named").alias(query_id)).distinct()
    best = _first(_scores(candidates, postings, asked).where("score > 0"), "query", k, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row"))
    return best.join(named, "query").select(query_id, F.col("rank").cast("int").alias("rank"), "doc_id", "score")
