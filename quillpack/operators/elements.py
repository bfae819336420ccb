"""Rows of conversations, captions and edits as ordered elements, and the estimates and filters on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw_int
from ..functions.text import blank, n_tokens, strip, without_image_tags

ELEMENT = "array<struct<type:string,has_loss:int,text:string,round:int>>"


def turn_text(turn: Column, fields: list[str]) -> tuple[Column, Column]:
    """(user text, assistant text) of a turn struct in any of three styles; keys are tested for null, not for presence."""
    get = lambda name: turn[name] if name in fields else F.lit(None).cast("string")
    user = F.coalesce(get("user"), F.when(get("from").isin("human", "user"), get("value")), F.when(get("role") == "user", get("content")))
    reply = F.coalesce(get("assistant"), F.when(get("from").isin("gpt", "assistant"), get("value")), F.when(get("role") == "assistant", get("content")))
    return user, reply


def rounds(turns: Column, fields: list[str]) -> Column:
    """Number of turns if the first has a user key with a value, else half the messages."""
    first = F.get(turns, F.lit(0))["user"].isNotNull() if "user" in fields else F.lit(False)
    return F.when(first, F.size(turns)).otherwise(F.floor(F.size(turns) / 2)).cast("int")


def conversation_elements(turns: Column, fields: list[str], images: Column | None = None) -> Column:
    """Images first; then each turn's user text without image tags (dropped if empty) and reply (dropped if empty)."""
    n = rounds(turns, fields)

    def of(turn: Column) -> Column:
        user, reply = turn_text(turn, fields)
        text = lambda loss, x: F.struct(F.lit("text").alias("type"), F.lit(loss).alias("has_loss"), x.alias("text"), n.alias("round"))
        return F.filter(F.array(text(0, without_image_tags(user)), text(1, reply)), lambda e: F.coalesce(e["text"] != "", F.lit(False)))

    texts = F.flatten(F.transform(turns, of))
    if images is None:
        return texts
    image = F.struct(F.lit("image").alias("type"), F.lit(0).alias("has_loss"), F.lit(None).cast("string").alias("text"), n.alias("round"))
    return F.concat(F.array_repeat(image, images), texts)


def flat_elements(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, order, type, has_loss, text, round for a table with one row a message (role, text). One shuffle, on key.

    Messages of other roles give no element but count for the rounds.
    """
    n = F.floor(F.count("*").over(Window.partitionBy(key)) / 2).cast("int")
    text = F.when(F.col("role") == "user", without_image_tags(F.col("text"))).when(F.col("role") == "assistant", F.col("text"))
    out = turns.select(key, order, F.lit("text").alias("type"), (F.col("role") == "assistant").cast("int").alias("has_loss"), text.alias("text"), n.alias("round"))
    return out.where(F.col("text") != "")


def plan_stats(elements: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, n_items, n_loss, num_tokens, est (with two marks an item), round; items without tokens are dropped."""
    items = elements.withColumn("n", n_tokens(F.col("text"))).where("n > 0")
    return items.groupBy(key).agg(F.count("*").alias("n_items"), F.sum("has_loss").cast("long").alias("n_loss"), F.sum("n").alias("num_tokens"), (F.sum("n") + 2 * F.count("*")).alias("est"), F.max("round").alias("round"))


def with_loss(stats: DataFrame) -> DataFrame:
    return stats.where("n_loss > 0")


def inline_elements(text: Column, n_images: Column | int) -> Column:
    """Text cut at image tags: pieces that aren't blank, stripped, and an image behind piece k if there is a next and k < n_images.

    Text without a tag stays as it is.
    """
    parts = F.split(text, "<image>", -1)
    last = F.size(parts) - 1
    item = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    images = F.lit(n_images) if isinstance(n_images, int) else n_images
    none = F.lit(None).cast("string")
    pair = lambda x, k: F.filter(F.array(item("text", F.when(~blank(x), strip(x))), F.struct(F.when((k < last) & (k < images), "image").alias("type"), none.alias("text"))), lambda e: (e["type"] == "image") | e["text"].isNotNull())
    return F.when(last == 0, F.array(item("text", text))).otherwise(F.flatten(F.transform(parts, pair)))


def placeholder_elements(text: Column, names: Column) -> Column:
    """Text cut at <img><|image_N|></img>, and image_N where the sample has it; then the output image.

    names: the sample's member names. Input images carry a loss in this form.
    """
    pattern = r"<img><\|(image_\d+)\|></img>"
    parts = F.split(text, r"<img><\|image_\d+\|></img>", -1)
    marks = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    item = lambda kind, x, loss: F.struct(F.lit(kind).alias("type"), x.alias("text"), loss.cast("int").alias("has_loss"))

    def of(x: Column, k: Column) -> Column:
        name = F.get(marks, k)
        found = name.isNotNull() & F.array_contains(names, F.concat(name, F.lit(".jpg")))
        return F.filter(F.array(item("text", F.when(~blank(x), x), F.lit(0)), item("image", F.when(found, name), F.lit(1))), lambda e: e["text"].isNotNull())

    return F.concat(F.flatten(F.transform(parts, of)), F.array(item("image", F.lit("output"), F.lit(1))))


def chosen_caption(captions: Column, seed: int, *keys: Column | str) -> Column:
    """A uniform draw from the captions that aren't blank, stripped; one space if there is none."""
    good = F.filter(captions, lambda c: ~blank(c))
    return F.when(F.size(good) == 0, F.lit(" ")).otherwise(strip(F.element_at(good, (draw_int(0, F.size(good) - 1, seed, "caption", *keys) + 1).cast("int"))))


def single_caption(caption: Column) -> Column:
    """The caption, or null (the row is skipped) where it is blank."""
    return F.when(~blank(caption), caption)


def member_caption(members: Column) -> Column:
    """Caption of a tar sample: txt, else the prompt of json, else the second of two turns in json, else prompt.txt."""
    text = lambda k: members[k].cast("string")
    conv = F.from_json(text("json"), "struct<prompt:string,conversations:array<struct<value:string>>>")
    two = F.when(F.size(conv["conversations"]) == 2, F.get(conv["conversations"], F.lit(1))["value"])
    return F.coalesce(text("txt"), conv["prompt"], two, text("prompt.txt"))


def input_images(members: Column) -> Column:
    """The greatest N of the members image_N.jpg; 0 without one."""
    numbers = F.transform(F.map_keys(members), lambda k: F.try_to_number(F.regexp_extract(k, r"^image_(\d+)\.jpg$", 1), F.lit("999999999")).cast("int"))
    return F.coalesce(F.array_max(numbers), F.lit(0))


def trajectory(n: Column, seed: int, *keys: Column | str) -> Column:
    """A sub-sequence of an edit history of n images: struct(start, end, merged): two draws, and a coin for merging the instructions."""
    start = draw_int(0, n - 2, seed, "edit/start", *keys)
    end = draw_int(start + 1, F.least(start + 3, n) - 1, seed, "edit/end", *keys)
    coin = draw_int(0, 1, seed, "edit/merge", *keys)
    merged = (end - start > 1) & (coin == 0)
    return F.struct(start.alias("start"), F.when(merged & (end == n - 1), end - 1).otherwise(end).alias("end"), merged.alias("merged"))


def without_empty(members: Column) -> Column:
    """Members that have bytes."""
    return F.map_filter(members, lambda _, v: v.isNotNull() & (F.length(v) > 0))


def video_as_images(text: Column, frames: Column) -> Column:
    return F.replace(text, F.lit("<video>"), F.repeat(F.lit("<image>"), frames))


def image_items(loss: Column, vae: Column, vit: Column) -> Column:
    """Plan items of one image: a target, a condition, and patches to look at, where each is wanted."""
    item = lambda kind, is_loss, wanted: F.struct(F.when(wanted, F.lit(kind)).alias("type"), F.lit(is_loss).alias("loss"), F.lit(1).alias("enable_cfg"))
    return F.filter(F.array(item("vae_image", 1, loss), item("vae_image", 0, vae), item("vit_image", 0, vit)), lambda x: x["type"].isNotNull())


def images_first(turns: Column, images: Column | int) -> Column:
    """All images, then the texts without tags: a question is dropped if empty, an answer never. Turns are (from, value)."""
    n = F.floor(F.size(turns) / 2).cast("int")
    item = lambda kind, loss, x: F.struct(F.lit(kind).alias("type"), loss.cast("int").alias("has_loss"), x.alias("text"), n.alias("round"))
    good = F.filter(turns, lambda t: (t["from"] == "gpt") | ((t["from"] == "human") & (without_image_tags(t["value"]) != "")))
    texts = F.transform(good, lambda t: item("text", t["from"] == "gpt", F.when(t["from"] == "human", without_image_tags(t["value"])).otherwise(t["value"])))
    return F.concat(F.array_repeat(item("image", F.lit(0), F.lit(None).cast("string")), F.lit(images) if isinstance(images, int) else images), texts)


def inline_conversation(turns: Column, images: Column | int) -> Column:
    """Each turn's text cut at its image tags, images in their places; has_loss of answers."""
    n = F.floor(F.size(turns) / 2).cast("int")

    def of(turn: Column) -> Column:
        loss = (turn["from"] == "gpt").cast("int")
        return F.transform(inline_elements(turn["value"], images), lambda e: F.struct(e["type"].alias("type"), F.when(e["type"] == "text", loss).otherwise(0).alias("has_loss"), e["text"].alias("text"), n.alias("round")))

    return F.flatten(F.transform(turns, of))


def plain_edit(text: Column, members: Column) -> Column:
    """Images 1..N, however many the sample has, as conditions; the text without tags; the output image."""
    item = lambda kind, x, loss: F.struct(F.lit(kind).alias("type"), x.alias("text"), F.lit(loss).alias("has_loss"))
    numbers = F.array_sort(F.transform(F.filter(F.map_keys(members), lambda k: k.rlike(r"^image_[1-9]\d{0,8}\.jpg$")), lambda k: F.regexp_extract(k, r"\d+", 0).cast("int")))
    names = F.transform(numbers, lambda i: F.concat(F.lit("image_"), i.cast("string")))
    said = F.rtrim(F.replace(text, F.lit("<image>"), F.lit("")))
    return F.concat(F.transform(names, lambda n: item("image", n, 0)), F.array(item("text", said, 0), item("image", F.lit("output"), 1)))


def edit_steps(n: Column, instructions: Column, seed: int, *keys: Column | str) -> Column:
    """The chosen part of an edit history as (image, instruction, image, ..): step by step, or first and last with the instructions
    joined. An instruction is drawn from its alternatives."""
    t = trajectory(n, seed, *keys)
    pick = lambda i: F.element_at(F.get(instructions, i.cast("int")), (draw_int(0, F.size(F.get(instructions, i.cast("int"))) - 1, seed, "edit/say", *keys, i) + 1).cast("int"))
    said = F.transform(F.sequence(t["start"], F.greatest(t["end"] - 1, t["start"])), pick)
    joined = F.regexp_replace(F.array_join(said, ". "), r"[ \t\n\r\f\x0b]+$", "")
    step = lambda image, text: F.struct(image.cast("int").alias("image"), text.alias("text"))
    last = F.array(step(t["end"], F.lit(None).cast("string")))
    return F.when(t["merged"], F.concat(F.array(step(t["start"], joined)), last)).otherwise(F.concat(F.transform(said, lambda x, i: step(t["start"] + i, x)), last))


def edit_format(members: Column) -> Column:
    """How a tar sample of edits is laid out, by the members it has; null: left out."""
    has = lambda k: F.map_contains_key(members, k)
    return F.when(has("output.jpg"), "multi").when(has("src_img.jpg") & has("edited_img.jpg") & has("edited_prompt.txt"), "pair").when(has("1.1.jpg"), F.lit(None).cast("string")).when(has("1.0.jpg") & has("2.jpg") & has("json"), "numbered")


def renamed_members(members: Column) -> Column:
    """Members of pair samples that lack an extension get the one of their kind."""
    image, text = F.array(*map(F.lit, ("src_img", "edited_img"))), F.array(F.lit("edited_prompt"))
    return F.transform_keys(members, lambda k, _: F.when(F.array_contains(image, k), F.concat(k, F.lit(".jpg"))).when(F.array_contains(text, k), F.concat(k, F.lit(".txt"))).otherwise(k))


def kept_items(plan: Column, p_text: float, p_vit: float, p_vae: float, seed: int, *keys: Column | str) -> Column:
    """Plan items behind guidance dropout, each with the rope step that it still makes: a dropped image steps by one, a dropped text by
    none. Items that guidance isn't enabled for stay."""
    from ..functions.draws import draw

    def of(item: Column, i: Column) -> Column:
        p = F.when(item["type"] == "text", p_text).when(item["type"] == "vit_image", p_vit).otherwise(p_vae)
        gone = (item["enable_cfg"] == 1) & (draw(seed, "dropout", *keys, i) < p)
        return F.struct(item.alias("item"), gone.alias("dropped"), F.when(gone & (item["type"] != "text"), 1).otherwise(0).alias("rope"))

    return F.transform(plan, of)


ITEM = "struct<type:string,enable_cfg:int,loss:int,special_token_loss:int,special_token_label:int,split_start:boolean,split_end:boolean,frame_delta:bigint>"


def _item(kind: str, cfg: Column | int, loss: Column | int, start: Column | bool = True, end: Column | bool = True, delta: Column | None = None) -> Column:
    values = {"type": kind, "enable_cfg": cfg, "loss": loss, "special_token_loss": 0, "special_token_label": None, "split_start": start, "split_end": end, "frame_delta": delta}
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items())).cast(ITEM)


def text_item(loss: Column | int, cfg: Column | int = 1) -> Column:
    """The plan item of a text: guided by default, a split of its own."""
    return _item("text", cfg, loss)


def video_items(frames: Column, loss: Column, cfg: Column | int = 1) -> Column:
    """Plan items of a video, one a frame (index, ...) in order: the first opens a split and the last one ends it, and all but the last say how far the next is.

    With a loss frames are targets, which are never guided.
    """

    def item(f: Column, i: Column) -> Column:
        following = F.get(frames, i + 1)["index"] - f["index"]
        guided = F.when(loss == 1, 0).otherwise(cfg if isinstance(cfg, Column) else F.lit(cfg))
        return _item("vae_image", guided, loss, i == 0, i == F.size(frames) - 1, following)

    return F.transform(frames, item)


def frame_tokens(frames: Column, stride: int) -> Column:
    """Latent tokens of all frames (h, w)."""
    return F.aggregate(frames, F.lit(0).cast("long"), lambda a, f: a + F.floor(f["w"] * f["h"] / (stride * stride)))
