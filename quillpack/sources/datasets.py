"""Dataset groups: configuration, catalog, and readers that give samples of one shape.

A reader returns dataset, key, elements (type, has_loss, text, round), n_images. Image bytes stay in the source's rows until a pixel function asks for them; tokens
are counted by the default tokenizer or by one that is passed in.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..functions.text import blank, n_tokens, strip
from ..operators import elements as E
from .readers import json_lines, parquet_rows, text_lines
from .shards import tar_samples

# Optional caption columns, in the order that they are gathered in.
CAPTIONS = (
    "caption_composition", "caption_composition_cn",
    "caption_entity", "caption_entity_cn",
    "caption_text", "caption_text_cn",
    "caption_imaginative", "caption_imaginative_cn",
    "caption_style", "caption_style_cn",
    "caption_abstract", "caption_abstract_cn",
    "caption_detail", "caption_detail_cn",
    "caption_original", "caption_original_cn",
)


@dataclass
class Group:
    """A group of datasets: weight in the mixture (0 by default), whether every pack opens with it, files used of each dataset."""

    name: str
    datasets: list[str]
    weight: float = 0.0
    mandatory: bool = False
    used: list[int | None] = field(default_factory=list)
    resume: bool = True


def groups(config: dict) -> list[Group]:
    """Groups of a parsed configuration. A number of files that isn't an integer means all; an auxiliary flag is accepted and ignored."""
    out = []
    for name, g in config.items():
        used = [n if isinstance(n, int) and not isinstance(n, bool) else None for n in g.get("num_used_data", [])]
        names = list(g["dataset_names"])
        out.append(Group(name, names, float(g.get("weight", 0.0)), bool(g.get("is_mandatory", False)), used + [None] * (len(names) - len(used)), bool(g.get("resume_data_status", True))))
    if sum(g.weight for g in out) <= 0:
        raise ValueError("the weights of the groups must sum to more than 0")
    return out


def root(catalog: dict, group: str, dataset: str) -> str:
    """A dataset's folder, with environment variables filled in; KeyError for an unknown one."""
    return os.path.expandvars(catalog[group][dataset]["data_dir"])


def zipped(*lists: DataFrame, ordinal: str = "line") -> DataFrame:
    """Lists of rows numbered by `ordinal` side by side, as long as the shortest; other columns must have different names."""
    out = lists[0]
    for x in lists[1:]:
        out = out.join(x, ordinal)
    return out


def used_lines(spark: SparkSession, sources: DataFrame, seed: int | None = None) -> DataFrame:
    """source, folder, line, value: the first `quota` lines (all, if null) of each of sources (line, path, folder, quota), in a drawn order with a seed.

    Sources are configuration: a file each, read by a scan of its own.
    """
    out = None
    for r in sources.orderBy("line").collect():
        rows = text_lines(spark, r["path"])
        order = [draw(seed, "lines", "line"), F.col("line")] if seed is not None else [F.col("line")]
        rows = rows if r["quota"] is None else rows.orderBy(*order).limit(r["quota"])
        rows = rows.select(F.lit(r["line"]).cast("long").alias("source"), F.lit(r["folder"]).alias("folder"), "line", "value")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "source long, folder string, line long, value string")


def merged_info(infos: list[dict]) -> dict:
    """Side information of several datasets; later ones win."""
    out: dict = {}
    for x in infos:
        out |= x
    return out


def _sample(df: DataFrame, dataset: str, key: list[str], elements: Column, images: Column) -> DataFrame:
    return df.select(F.lit(dataset).alias("dataset"), *key, elements.alias("elements"), images.cast("int").alias("n_images"))


def _fields(df: DataFrame, name: str) -> list[str]:
    return df.schema[name].dataType.elementType.names


def captioned_rows(df: DataFrame, dataset: str, seed: int) -> DataFrame:
    """Text-to-image rows: a caption column must not be blank; without one, a draw from the optional columns, or one space."""
    key = ["file_path", "row_index"]
    if "caption" in df.columns:
        df = df.where(~blank(F.col("caption")))
        said = strip(F.col("caption"))
    else:
        said = E.chosen_caption(F.array(*[F.col(c) for c in CAPTIONS if c in df.columns] or [F.lit(None).cast("string")]), seed, *key)
    text = F.struct(F.lit("text").alias("type"), F.lit(0).alias("has_loss"), said.alias("text"), F.lit(0).alias("round"))
    image = F.struct(F.lit("image").alias("type"), F.lit(1).alias("has_loss"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("round"))
    return _sample(df, dataset, key, F.array(text, image), F.lit(1))


def captioned_shards(df: DataFrame, dataset: str) -> DataFrame:
    """Text-to-image tar samples; those without an image or a caption are left out."""
    m = F.col("members")
    image = F.coalesce(m["jpg"], m["png"], m["good_image.jpg"])
    said = E.member_caption(m)
    text = F.struct(F.lit("text").alias("type"), F.lit(0).alias("has_loss"), said.alias("text"), F.lit(0).alias("round"))
    target = F.struct(F.lit("image").alias("type"), F.lit(1).alias("has_loss"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("round"))
    return _sample(df.where("error is null").where(image.isNotNull() & said.isNotNull()), dataset, ["shard", "sample_idx"], F.array(text, target), F.lit(1))


def conversation_rows(df: DataFrame, dataset: str, image_needed: bool) -> DataFrame:
    """Conversation rows (texts or conversations, in any of three styles), images first; without a turn column nothing is read."""
    name = next((c for c in ("texts", "conversations") if c in df.columns), None)
    n = F.lit(0)
    if "image" in df.columns:
        n = F.when(F.col("image").isNotNull(), 1).otherwise(n)
    if "images" in df.columns:
        n = F.when(F.size("images") > 0, F.size("images")).otherwise(n)
    if name is None:
        df, turns, fields = df.limit(0), F.array().cast("array<struct<role:string,content:string>>"), ["role", "content"]
    else:
        turns, fields = F.col(name), _fields(df, name)
    out = _sample(df, dataset, ["file_path", "row_index"], E.conversation_elements(turns, fields, n), n)
    return trainable(out.where("n_images > 0") if image_needed else out)


TURNS = "struct<conversations:array<struct<`from`:string,value:string>>>"


def conversation_shards(df: DataFrame, dataset: str, inline: bool) -> DataFrame:
    """Conversation tar samples: images inline at their tags (and optional), or first (and needed)."""
    m = E.without_empty(F.col("members"))
    df = df.where("error is null").withColumn("turns", F.from_json(F.col("members")["json"].cast("string"), TURNS)["conversations"]).withColumn("n", (F.map_contains_key(m, "jpg") | F.map_contains_key(m, "png")).cast("int"))
    elements = E.inline_conversation(F.col("turns"), F.col("n")) if inline else E.images_first(F.col("turns"), F.col("n"))
    df = df.where(F.col("turns").isNotNull())
    return trainable(_sample(df if inline else df.where("n > 0"), dataset, ["shard", "sample_idx"], elements, F.col("n")))


def conversation_lines(spark: SparkSession, path: str, dataset: str, frames: Column | None = None, seed: int | None = None, most: int | None = None) -> DataFrame:
    """Conversation JSON lines, images inline; a video's tag in the first turn stands for its frames. Samples have no rounds (0)."""
    df = json_lines(spark, path, "image string, video string, conversations array<struct<`from`:string,value:string>>", seed, most)
    df = df.where(F.col("value.conversations").isNotNull()).select("line", "value.*")
    n = F.when(F.col("image").startswith("["), F.size(F.from_json("image", "array<string>"))).when(F.col("image").isNotNull(), 1).otherwise(0)
    turns = F.col("conversations")
    if frames is not None:
        n = F.when(F.col("video").isNotNull(), frames).otherwise(n)
        first = F.get(turns, F.lit(0))
        swapped = F.concat(F.array(first.withField("value", E.video_as_images(first["value"], frames))), F.slice(turns, F.lit(2), F.size(turns)))
        turns = F.when(F.col("video").isNotNull(), swapped).otherwise(turns)
    elements = F.transform(E.inline_conversation(turns, n), lambda e: e.withField("round", F.lit(0)))
    return trainable(_sample(df, dataset, ["line"], elements, n))


def edit_rows(df: DataFrame, dataset: str, seed: int) -> DataFrame:
    """Edit rows: a history of images and instructions, or a pair with alternative instructions."""
    key = ["file_path", "row_index"]
    if "image_list" in df.columns:
        n, said = F.size("image_list"), F.col("instruction_list")
    else:
        n, said = F.lit(2), F.array(F.col("edited_prompt_list"))
    steps = E.edit_steps(n, said, seed, *key)
    none = F.lit(None).cast("string")
    item = lambda kind, loss, x: F.struct(F.lit(kind).alias("type"), loss.cast("int").alias("has_loss"), x.alias("text"), F.lit(0).alias("round"))
    elements = F.flatten(F.transform(steps, lambda s, i: F.when(s["text"].isNull(), F.array(item("image", i > 0, none))).otherwise(F.array(item("image", i > 0, none), item("text", F.lit(0), s["text"])))))
    return _sample(df.where(n >= 2), dataset, key, elements, F.size(steps))


def edit_shards(df: DataFrame, dataset: str) -> DataFrame:
    """Edit tar samples in any of the formats; unknown ones are left out."""
    m = E.renamed_members(F.col("members"))
    df = df.where("error is null").withColumn("m", m).withColumn("format", E.edit_format(F.col("m"))).where("format is not null")
    text = F.coalesce(F.col("m")["txt"].cast("string"), F.col("m")["edited_prompt.txt"].cast("string"), F.get_json_object(F.col("m")["json"].cast("string"), "$.instruction"))
    marked = text.rlike(r"<img><\|image_\d+\|></img>")
    said = F.replace(text, F.lit("<image>"), F.lit(""))
    pair = F.array(*[F.struct(F.lit(k).alias("type"), t.alias("text"), F.lit(x).alias("has_loss")) for k, t, x in (("image", F.lit("input"), 0), ("text", said, 0), ("image", F.lit("output"), 1))])
    elements = F.when((F.col("format") == "multi") & marked, E.placeholder_elements(text, F.map_keys("m"))).when(F.col("format") == "multi", E.plain_edit(text, F.col("m"))).otherwise(pair)
    shaped = F.transform(elements, lambda e: F.struct(e["type"].alias("type"), e["has_loss"].alias("has_loss"), e["text"].alias("text"), F.lit(0).alias("round")))
    return _sample(df, dataset, ["shard", "sample_idx"], shaped, F.size(F.filter(elements, lambda e: e["type"] == "image")))


def trainable(samples: DataFrame) -> DataFrame:
    """Samples with an element that has a loss."""
    return samples.where(F.exists("elements", lambda e: e["has_loss"] == 1))


def estimated(samples: DataFrame, image_tokens: int = 0, tokens: Callable[[Column], Column] = n_tokens) -> DataFrame:
    """samples with num_tokens and est (two marks an element); texts without tokens count for nothing."""
    n = F.transform("elements", lambda e: F.when(e["type"] == "image", F.lit(image_tokens).cast("long")).otherwise(tokens(e["text"])))
    items = F.filter(n, lambda x: x > 0) if not image_tokens else n
    total = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
    return samples.withColumn("num_tokens", total).withColumn("est", total + 2 * F.size(items))


#: Readers by kind of group.
READERS: dict[str, Callable[..., DataFrame]] = {
    "t2i_parquet": lambda spark, paths, seed=0: captioned_rows(parquet_rows(spark, *paths), "t2i_parquet", seed),
    "t2i_wds": lambda spark, paths, seed=0: captioned_shards(tar_samples(spark, *paths), "t2i_wds"),
    "vlm_parquet": lambda spark, paths, seed=0: conversation_rows(parquet_rows(spark, *paths), "vlm_parquet", True),
    "sft_parquet": lambda spark, paths, seed=0: conversation_rows(parquet_rows(spark, *paths), "sft_parquet", False),
    "vlm_wds": lambda spark, paths, seed=0: conversation_shards(tar_samples(spark, *paths), "vlm_wds", False),
    "llm_wds": lambda spark, paths, seed=0: conversation_shards(tar_samples(spark, *paths), "llm_wds", True),
    "unified_edit": lambda spark, paths, seed=0: edit_rows(parquet_rows(spark, *paths), "unified_edit", seed),
    "unified_wds_edit": lambda spark, paths, seed=0: edit_shards(tar_samples(spark, *paths), "unified_wds_edit"),
}
