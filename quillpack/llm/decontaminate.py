"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every window of WINDOW words the least hash of its GRAM-word runs is kept; neighbouring windows mostly have the same one, so a text is
winnowed to the distinct ones. Windows with the same words have the same one, so training and test texts that share a window
meet in the join of their fingerprints. An item with fewer words than a window is one window of its own length, its
fingerprint the hash of all its words. Texts that meet a fingerprint are read again, and there a hit is extended from the fingerprint to the whole
window and compared word by word. Any shared span of WINDOW words or more is thus covered whole.

All sizes of windows are worked through in one pass. What is joined first is a text's key and its fingerprints, then the keys of those that met; a text goes
with its windows only where no shuffle follows. The test side, and the keys, are broadcast if they were
counted to be at most BROADCAST_ROWS rows, else the joins shuffle, and skewed fingerprints are split at run time.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WINDOW, GRAM = 10, 5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, NOT_WORD, -1), "")


def _run(i: Column, n: int) -> Column:
    """The hash of the n words from word i on (from 0), out of the words' hashes h."""
    return F.xxhash64(*(F.get(F.col("h"), i + j) for j in range(n)))


def _windows(rows: DataFrame, sizes: list[int], window: int, gram: int, winnowed: bool = False) -> DataFrame:
    """rows (with w): size, p and f of every window, w with them; or, winnowed, without w, the first of neighbours that have the same fingerprint."""
    keys = [c for c in rows.columns if c != "w"] + ([] if winnowed else ["w"])
    p, least = F.col("p"), sizes[0]
    cut = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).where(F.size("h") >= least).select(*keys, "h", F.explode(F.sequence(F.lit(0), F.size("h") - least)).alias("p"))
    runs = [f"r{i}" for i in range(window - gram + 2)]
    if sizes[-1] == window:
        # run 0 is the one before the window's own
        cut = cut.select(*keys, "h", "p", *(_run(p + i - 1, gram).alias(r) for i, r in enumerate(runs)))
        best = lambda own: F.least(*own) if len(own) > 1 else own[0]
        cut = cut.select(*keys, "h", "p", best([F.col(r) for r in runs[1:]]).alias("f"), best([F.col(r) for r in runs[:-1]]).alias("before"))

    def found(n: int) -> Column:
        if n < window:
            return F.when(p + n <= F.size("h"), F.struct(F.lit(n).alias("size"), F.xxhash64(F.lit(n), _run(p, n)).alias("f")))
        fits = F.lit(True) if n == least else p + n <= F.size("h")
        if winnowed:
            fits = fits & ((p == 0) | (F.col("f") != F.col("before")))
        return F.when(fits, F.struct(F.lit(n).alias("size"), F.col("f").alias("f")))

    # an array of what there is, which no filter is pushed through
    every = F.when(found(least).isNotNull(), F.array(found(least))) if len(sizes) == 1 else F.array(*map(found, sizes))
    return cut.select(*keys, "p", F.explode(every).alias("x")).where("x is not null").select(*keys, "x.size", "p", "x.f")


def _spelled(df: DataFrame) -> DataFrame:
    return df.withColumn("t", F.array_join(F.slice("w", F.col("p") + 1, F.col("size")), " ")).drop("w")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """k1, k2 (the document and its text's hash), p, size, items: document windows that occur in the benchmark and the items that have them.

    A null text or item has no words and no window; a null doc_id or item_id stays; rows that repeat a document and its text give their
    windows each; without items, or without documents, there is no row.
    """
    tests = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    sizes = sorted({min(r[0], window) for r in tests.select(F.least(F.size("w"), F.lit(window))).distinct().collect()})  # at most `window` numbers
    if not sizes:
        return docs.select(F.col("doc_id").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).alias("p"), F.lit(0).alias("size"), F.array(F.lit(0).cast("long")).alias("items")).limit(0)
    test = _windows(tests, sizes, window, gram)
    # an item shorter than a window is one window, a longer one has none of the shorter sizes
    test = _spelled(test.where((F.col("size") == window) | (F.col("size") == F.size("w")))).groupBy("size", "f", "t").agg(F.collect_set("item_id").alias("items"))
    test = materialise(test, "tests")
    found = test.select("f").distinct()
    small = test.count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), words(F.col("text")).alias("w"))
    prints = _windows(rows, sizes, window, gram, winnowed=True).select("k1", "k2", "f")
    met = materialise(prints.join(F.broadcast(found) if small else found, "f", "left_semi").select("k1", "k2").distinct(), "met")
    keys = met.toDF("m1", "m2")
    keys = F.broadcast(keys) if met.count() <= BROADCAST_ROWS else keys
    own = _windows(rows.join(keys, rows["k1"].eqNullSafe(keys["m1"]) & (rows["k2"] == keys["m2"]), "left_semi"), sizes, window, gram)
    spelled = _spelled(own.join(F.broadcast(found), "f", "left_semi") if small else own)
    return spelled.join(F.broadcast(test) if small else test, ["size", "f", "t"]).select("k1", "k2", "p", "size", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and its text's hash k2.

    A null text has no words, and an item without words occurs nowhere. Rows that repeat a document with its text get the same
    values each; an empty benchmark hits nothing; a null item_id hits but isn't listed; a null doc_id stays. Other columns
    are left out.
    """
    spans = F.array_sort(F.collect_set(F.struct(F.col("p").alias("p"), F.col("size").alias("size"))))
    covered = F.aggregate(F.col("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(F.greatest(a["end"], x["p"] + x["size"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["p"] + x["size"] - F.greatest(a["end"], x["p"]))).alias("n")))["n"]
    by_doc = hits(docs, benchmark, window, gram).groupBy("k1", "k2").agg(spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    by_doc = by_doc.select("k1", "k2", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",").alias("list"))
    base = docs.select("doc_id", F.xxhash64("text").alias("h2"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = base.join(by_doc, base["doc_id"].eqNullSafe(by_doc["k1"]) & (base["h2"] == by_doc["k2"]), "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"), (n > 0).alias("contaminated"), F.col("h2").alias("k2"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of docs without a benchmark window, with all their columns.

    Rows with a null text or without a word stay, as do all if the benchmark is empty; repeated rows stay or go together.
    """
    bad = hits(docs, benchmark, window, gram).select("k1", "k2").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["k1"]) & (F.xxhash64(docs["text"]) == bad["k2"]), "left_anti")
