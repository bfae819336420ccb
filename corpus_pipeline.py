"""Curate and pack the corpus: toxicity, near copies, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir). What a stage returns is written as Parquet and read again as the next one's
docs; all but the last return the columns of documents. A null text is empty throughout.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from quillpack.llm.common import documents, fold, materialise
from quillpack.llm.decontaminate import decontaminated
from quillpack.llm.packing import pack
from quillpack.llm.shingles import similar
from quillpack.llm.suffixes import repeated_passages
from quillpack.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.7 or more. Labels of documents whose crc32 is 1 modulo 3 are not learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, labels.where(fold("doc_id", 3) != 1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each component of texts with a similarity of 0.8 or more (five-word shingles).

    Candidates come from op4's byte-position SimHash index, those that it can't promise to find from MinHash; all are verified on whole shingle sets.

    Of a component's rows with that doc_id the first by text, then by the other columns, stays, and rows with one doc_id in different components all
    do; rows without a doc_id stay. Columns may have any names. Without documents there is no row.
    """
    taken = {c.lower() for c in docs.columns}
    root, component, place = ([n for n in (f"{x}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken][0] for x in ("root", "component", "place"))
    rows = similar(docs, root, component)
    own = [F.col(f"`{c}`") for c in docs.columns]
    one = rows.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col(component)))
    # ids that repeat within a component are rare: only for them are texts dealt out once more
    many = materialise(one.where("doc_id is not null").groupBy("doc_id", root).count().where("count > 1").select("doc_id", root), "many")
    if many.isEmpty():
        return one.select(own)
    order = ["text", *(f.name for f in docs.schema if isinstance(f.dataType, AtomicType) and f.name != "text")]
    first = F.row_number().over(Window.partitionBy("doc_id", root).orderBy(*(F.col(f"`{c}`") for c in order)))
    chosen = one.join(many, ["doc_id", root], "left_semi").withColumn(place, first).where(F.col(place) == 1)
    return one.join(many, ["doc_id", root], "left_anti").select(own).unionByName(chosen.select(own))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of every text the passages of 35 words and more that start anywhere else too. No document is dropped."""
    return repeated_passages(docs, clean=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item, or a shorter item whole."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens, mixed by source."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Toxicity scores and fingerprint components are not within SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
