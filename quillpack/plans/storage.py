"""Files and back: tar shards, row groups, line ordinals, written from the given tables and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.packing import next_fit
from ..sources.packs import collated, read_collated, write_collated
from ..sources.readers import positioned, text_lines
from ..sources.scratch import parts, shared_path
from ..sources.shards import tar_samples, write_tar
from ..streaming.epochs import endless
from .registry import duck_words, query, table
from .samples import DOCS, doc_samples, packed


@query("""SELECT concat('s', doc_id % 8, '.tar') AS shard, (row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - 1)::BIGINT AS sample_idx, doc_id::VARCHAR AS key,
    strlen(coalesce(text, ''))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS txt, coalesce(lang, '') AS lang, NULL::VARCHAR AS error FROM documents""")
def tar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of documents, a text and a language member each, read in ranges of a quarter of a megabyte."""
    path = shared_path(spark, "shards")
    docs = table(spark, sf_dir, "documents").withColumn("shard", F.concat(F.lit("s"), F.col("doc_id") % 8, F.lit(".tar")))
    members = F.explode(F.array(F.struct(F.lit("txt").alias("ext"), F.coalesce("text", F.lit("")).alias("content")), F.struct(F.lit("meta.lang").alias("ext"), F.coalesce("lang", F.lit("")).alias("content"))))
    files = docs.select("shard", "doc_id", members.alias("m")).select("shard", "doc_id", "m.ext", F.concat(F.col("doc_id"), F.lit("."), F.col("m.ext")).alias("name"), "m.content")
    write_tar(files.withColumn("rank", (F.col("ext") != "txt").cast("int")), path, "doc_id", "rank")
    rows = tar_samples(spark, path, split=1 << 18)
    text = rows["members"]["txt"]
    return rows.select(F.element_at(F.split("shard", "/"), -1).alias("shard"), "sample_idx", "key", F.length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("txt"), rows["members"]["meta.lang"].cast("string").alias("lang"), "error")


@query("""SELECT (o_custkey % 4)::INT AS part, o_orderkey, ((row_number() OVER w - 1) // 1000)::INT AS row_group, ((row_number() OVER w - 1) % 1000)::BIGINT AS "row"
    FROM orders WINDOW w AS (PARTITION BY o_custkey % 4 ORDER BY o_orderkey)""")
def row_group_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row group and ordinal of every row of four files of groups of 1000 rows."""
    path = shared_path(spark, "groups")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4).cast("int").alias("part"))
    rows.repartition(4, "part").sortWithinPartitions("part", "o_orderkey").write.partitionBy("part").option("parquet.block.row.count.limit", 1000).parquet(path)
    part = F.regexp_extract("file_path", r"/part=(\d+)/", 1).cast("int")
    return positioned(spark, path).select(part.alias("part"), "o_orderkey", "row_group", "row")


@query("SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS line, doc_id, n_chars, lang FROM documents")
def line_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines in order of doc_id, and numbered by their lines."""
    path = shared_path(spark, "lines")
    docs = table(spark, sf_dir, "documents")
    docs.repartitionByRange(parts(docs), "doc_id").sortWithinPartitions("doc_id").select(F.to_json(F.struct("doc_id", "n_chars", "lang", "text")).alias("value")).write.text(path)
    rows = text_lines(spark, path).select("line", F.from_json("value", "doc_id long, n_chars long, lang string").alias("v"))
    return rows.select("line", "v.doc_id", "v.n_chars", "v.lang")


@query("""SELECT epoch, (o_custkey % 2)::BIGINT AS file, ((row_number() OVER w - 1) // 500)::BIGINT AS row_group, ((row_number() OVER w - 1) % 500)::BIGINT AS "row", o_orderkey, o_totalprice
    FROM orders, range(2) AS e(epoch) WINDOW w AS (PARTITION BY o_custkey % 2, epoch ORDER BY o_orderkey)""")
def endless_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of two files, streamed in three runs that go on from a checkpoint."""
    path, out, at = (shared_path(spark, x) for x in ("orders", "epochs", "checkpoint"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 2).alias("part"))
    rows.repartition(2, "part").sortWithinPartitions("part", "o_orderkey").write.partitionBy("part").option("parquet.block.row.count.limit", 500).parquet(path)
    n = spark.read.parquet(path).count()
    for _ in range(3):
        stream = endless(spark, path, rows=max(1, -(-2 * n // 3)), notes=f"{at}-notes/end")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).where("epoch < 2")


@query(packed(DOCS, "(doc_id % 8)::INT", "(doc_id % 64 // 8)::INT", "doc_id", 4096, 4096, f"""
    , w AS (SELECT doc_id AS seq, list_transform({duck_words("text")}, lambda v: strlen(v)) AS ids FROM documents)
    SELECT rank, worker, pack::BIGINT AS pack, sum(est)::BIGINT AS sequence_length, (count(*) + 1)::BIGINT AS n_lens, (4096 - sum(est))::BIGINT AS pad, sum(len(ids))::BIGINT AS n_ids, coalesce(sum(list_sum(ids)), 0)::BIGINT AS ids_sum,
        sum(CASE WHEN k > 0 THEN before ELSE 0 END)::BIGINT AS starts_sum, max(seq)::BIGINT AS last, max(max(seq)) OVER (PARTITION BY rank, worker)::BIGINT AS saved
    FROM (SELECT p.*, ids, sum(est) OVER (PARTITION BY rank, worker, pack ORDER BY seq) - est AS before FROM p JOIN w USING (seq)) GROUP BY rank, worker, pack"""))
def collated_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of documents, their words' lengths as ids, written as one step with the readers' positions and read back."""
    path, keys = shared_path(spark, "packs"), ["rank", "worker", "pack"]
    ids = F.transform(T.words(F.col("text")), lambda w: F.octet_length(w))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), ids.alias("ids"))
    rows = next_fit(doc_samples(spark, sf_dir), 4096).join(docs, "seq").withColumnRenamed("est", "length")
    rows = rows.withColumn("split_lens", F.array("length")).withColumn("attn_modes", F.array(F.lit("causal"))).withColumn("dataset", F.lit("documents"))
    rows = rows.withColumn("position", F.array("seq")).withColumn("firsts", F.array(F.lit(0).cast("long")))
    write_collated(collated(rows, keys, "seq", 4096, joined=["ids"], shifted=["firsts"]), path, 7, keys)
    packs, positions = read_collated(spark, path)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    saved = positions.select(F.col("reader")[0].cast("int").alias("rank"), F.col("reader")[1].cast("int").alias("worker"), F.col("position")[0].alias("saved"))
    return packs.join(saved, ["rank", "worker"]).select(
        *keys, "sequence_length", F.size("sample_lens").cast("long").alias("n_lens"), F.element_at("split_lens", -1).alias("pad"), F.size("ids").cast("long").alias("n_ids"), total("ids").alias("ids_sum"), total("firsts").alias("starts_sum"), F.col("positions")["documents"][0].alias("last"), "saved"
    )
