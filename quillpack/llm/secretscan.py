"""Secret scans in DataFrame functions only: patterns, and sliding windows of high Shannon entropy.

Three base kinds are patterns. Three more are classes of characters: a candidate is a maximal run of a class's characters that is
at least a window long, and every window of WINDOW characters whose entropy reaches the class's bound is a hit; hits that
overlap or touch are one span. The counts of a window's characters are kept from window to window, one character in and one out, and with
them the sum of c * log2(c) over the counts: the entropy is log2(WINDOW) - sum / WINDOW, so a bound on the entropy is one on the sum.
The terms are whole numbers (multiples of 2^-20), so a sum doesn't depend on the order of its updates.

Candidates on the allow-list give no entropy span (base spans stay): known digests of nothing, parts of an alphabet in its order,
plain words and numbers joined by separators, UUIDs, placeholders. All of it happens within a row: no shuffle. A text's matches are cut from its
gaps by the same pattern, and running sums of both lengths are the positions; sums, and long candidates, are worked through in
blocks, so that the work is linear in a text's length.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
SCALE = 1 << 20
#: Characters of a candidate, and numbers of a running sum, that are worked through together.
BLOCK = 512

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Base(NamedTuple):
    """A pattern, the group whose length counts, and the characters that it must have."""

    kind: str
    pattern: str
    group: int
    least: int


class Class(NamedTuple):
    """The characters of a class, as a pattern and one by one, and the entropy in bits that a window must reach."""

    kind: str
    pattern: str
    alphabet: str
    bits: float


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + f"|{_either('api')}_?{_either('key')}"
# a maximal run of hex digits, and one of capitals and digits behind AKIA, is long enough or not: its least length can stand in the pattern
BASES = (
    Base("assign", rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Base("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Base("hex", r"[0-9a-f]{16,}", 0, 16),
)
CLASSES = (
    Class("entropy_hex", "[0-9A-Fa-f]", DIGITS + "ABCDEFabcdef", 3.0),
    Class("entropy_base64", "[A-Za-z0-9+/]", UPPER + LOWER + DIGITS + "+/", 3.85),
    Class("entropy_url", "[A-Za-z0-9_-]", UPPER + LOWER + DIGITS + "_-", 3.85),
)
#: Digests of nothing (md5, sha1, sha256), which many texts quote.
EMPTY_DIGESTS = ("d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
#: Candidates that are one of these as a whole are let be.
ALLOWED = (
    r"[A-Z]?[a-z]+(?:[/_+-][A-Z]?[a-z]+)*",
    r"[0-9]+(?:[/_+-][0-9]+)*",
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r".*(?:EXAMPLE|example|placeholder|xxxxxx|XXXXXX).*",
)
#: Alphabets; a candidate that is a part of one of them is let be.
ORDERED = (DIGITS + LOWER, LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", DIGITS + UPPER + LOWER, DIGITS + "ABCDEF" + DIGITS + "ABCDEF", DIGITS + "abcdef" + DIGITS + "abcdef")


def terms(window: int = WINDOW) -> list[int]:
    """c * log2(c), scaled, for counts c from 0 to window."""
    return [round(c * math.log2(c) * SCALE) if c else 0 for c in range(window + 1)]


def bound(bits: float, window: int = WINDOW) -> int:
    """The largest scaled sum at which a window has `bits` of entropy."""
    return math.floor((math.log2(window) - bits) * window * SCALE)


def running(x: Column) -> Column:
    """Running sums of an array column of numbers."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(BLOCK)), lambda b: F.slice(x, b + 1, BLOCK))

    def within(first: Column, block: Column) -> Column:
        none = F.struct(first.alias("sum"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(block, none, lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.concat(a["out"], F.array(a["sum"] + v)).alias("out")), lambda a: a["out"])

    none = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<array<long>>").alias("out"))
    total = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, v: a + v)
    return F.flatten(F.aggregate(blocks, none, lambda a, b: F.struct((a["sum"] + total(b)).alias("sum"), F.concat(a["out"], F.array(within(a["sum"], b))).alias("out")), lambda a: a["out"]))


def _hits(part: Column, first: Column, cls: Class, window: int) -> Column:
    """start, end of the merged windows of a string of the class's characters that reach the bound, first being its position."""
    g, limit = F.array(*(F.lit(x).cast("long") for x in terms(window))), bound(cls.bits, window)
    span = "array<struct<start:long,end:long>>"
    zero = F.struct(F.array_repeat(F.lit(0), len(cls.alphabet)).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.array().cast(span).alias("out"))
    one = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))

    def scanned(codes: Column) -> Column:
        def moved(x: Column, i: Column) -> Column:
            new, old = F.get(codes, i), F.get(codes, i - window)
            out, same = F.get(x["n"], old), new == old
            before = F.get(x["n"], new) - F.when(same, 1).otherwise(0)
            s = x["s"] - F.coalesce(F.get(g, out) - F.get(g, out - 1), F.lit(0)) + F.get(g, before + 1) - F.get(g, before)
            n = F.transform(x["n"], lambda c, k: c + F.when(k == new, 1).otherwise(0) - F.when(k == old, 1).otherwise(0))
            return F.struct(n.alias("n"), s.alias("s"), x["a"].alias("a"), x["b"].alias("b"), x["out"].alias("out"))

        def step(x: Column, i: Column) -> Column:
            return F.element_at(F.transform(F.array(moved(x, i)), lambda y: marked(y, i)), 1)

        def marked(y: Column, i: Column) -> Column:
            hit, begin, end = (i >= window - 1) & (y["s"] <= limit), first + i - (window - 1), first + i + 1
            on = (y["a"] >= 0) & (begin <= y["b"])
            return F.struct(
                y["n"].alias("n"),
                y["s"].alias("s"),
                F.when(hit & ~on, begin).otherwise(y["a"]).alias("a"),
                F.when(hit, end).otherwise(y["b"]).alias("b"),
                F.when(hit & ~on & (y["a"] >= 0), F.concat(y["out"], one(y["a"], y["b"]))).otherwise(y["out"]).alias("out"),
            )

        done = lambda x: F.when(x["a"] >= 0, F.concat(x["out"], one(x["a"], x["b"]))).otherwise(x["out"])
        return F.aggregate(F.sequence(F.lit(0).cast("long"), F.size(codes).cast("long") - 1), zero, step, done)

    coded = F.transform(F.split(part, ""), lambda c: F.instr(F.lit(cls.alphabet), c) - 1)
    return F.element_at(F.transform(F.array(coded), scanned), 1)


def _entropic(at: Column, cls: Class, window: int) -> Column:
    """Spans of high entropy in candidates (text, start), allowed ones left out; pieces of one span that lie in two blocks are joined."""
    def suppressed(text: Column) -> Column:
        out = text.isin(*EMPTY_DIGESTS)
        for x in ALLOWED:
            out = out | text.rlike(f"^(?:{x})$")
        for x in ORDERED:
            out = out | (F.instr(F.lit(x), text) > 0)
        return out

    kept = F.filter(at, lambda c: ~suppressed(c["text"]))
    blocks = lambda c: F.sequence(F.lit(0), F.length(c["text"]) - window, F.lit(BLOCK))
    pieces = F.flatten(F.flatten(F.transform(kept, lambda c: F.transform(blocks(c), lambda b: _hits(F.substring(c["text"], b + 1, F.lit(BLOCK + window - 1)), c["start"] + b, cls, window)))))

    def joined(p: Column) -> Column:
        heads = F.filter(p, lambda x, i: (i == 0) | (x["start"] > F.get(p, i - 1)["end"]))
        tails = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (x["end"] < F.get(p, i + 1)["start"]))
        return F.zip_with(heads, tails, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    return F.element_at(F.transform(F.array(pieces), joined), 1)


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))


def _base_spans(i: int, b: Base) -> Column:
    """Matches of a base kind that are long enough; null where there is no match. Its matches, values and running sums are columns."""
    ends, texts = F.col(f"r_{b.kind}"), F.col(f"v_{b.kind}" if b.group else f"m_{b.kind}")
    spans = F.transform(f"m_{b.kind}", lambda m, j: F.when(F.length(F.get(texts, j)) >= b.least, _span(F.get(ends, 2 * j), i, F.get(ends, 2 * j + 1))))
    return F.when(F.size(f"m_{b.kind}") > 0, F.filter(spans, lambda s: s.isNotNull()))


def _class_spans(i: int, c: Class, window: int) -> Column:
    """Spans of high entropy of a class; null where there is no candidate."""
    at = F.transform(f"m_{c.kind}", lambda m, j: F.struct(m.alias("text"), F.get(F.col(f"r_{c.kind}"), 2 * j).alias("start")))
    spans = F.transform(_entropic(at, c, window), lambda s: _span(s["start"], i, s["end"]))
    return F.when(F.size(f"m_{c.kind}") > 0, spans)


def secret_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start, then kind, for every row; positions in code points, end exclusive.

    A null text is empty and has no span; repeated rows get the same spans each; a null doc_id stays; an empty table gives none;
    other columns are left out, whatever their names.
    """
    patterns = [(b.kind, b.pattern) for b in BASES] + [(c.kind, f"{c.pattern}{{{window},}}") for c in CLASSES]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in patterns))
    some = lambda k: F.size(f"m_{k}") > 0
    lengths = lambda k, p: F.flatten(F.zip_with(F.split("text", p, -1), F.col(f"m_{k}"), lambda g, m: F.array(F.length(g), F.coalesce(F.length(m), F.lit(0)))))
    value = F.when(some("assign"), F.regexp_extract_all("text", F.lit(BASES[0].pattern), F.lit(BASES[0].group)))
    cut = found.select("doc_id", value.alias("v_assign"), *(f"m_{k}" for k, _ in patterns), *(F.when(some(k), lengths(k, p)).alias(f"l_{k}") for k, p in patterns))
    summed = cut.select("doc_id", "v_assign", *(f"m_{k}" for k, _ in patterns), *(F.when(some(k), running(F.col(f"l_{k}"))).alias(f"r_{k}") for k, _ in patterns))
    every = [_base_spans(i, b) for i, b in enumerate(BASES)] + [_class_spans(len(BASES) + i, c, window) for i, c in enumerate(CLASSES)]
    whole = F.array_sort(F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<struct<start:long,kind:int,end:long>>")) for x in every))))
    names = F.array(*(F.lit(k) for k, _ in patterns))
    return summed.select("doc_id", F.transform(whole, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_counts(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256 and spans of every row, as secret_spans() has them."""
    kinds = [b.kind for b in BASES]
    rows = secret_spans(docs)
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(number, kinds), F.sha2(spelled(F.filter("spans", lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
