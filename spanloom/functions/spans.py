"""Span and interval columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word, maybe of several parts.
TOKEN = r"(?U)\b\w+(?:[-']\w+)*\b"

#: Tokens whose places are made together.
BLOCK = 128


def located(text: Column, span: Column) -> Column:
    """Start of the first case-insensitive occurrence, white space flexible, -1 if there is none."""
    exact = F.position(F.lower(span), F.lower(text)) - 1
    words = F.split(F.trim(F.lower(span)), r"\s+")
    pattern = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s+")
    flexible = F.regexp_instr(F.lower(text), pattern) - 1
    return F.when(F.trim(F.coalesce(span, F.lit(""))) == "", -1).when(exact >= 0, exact).otherwise(flexible)


def nth_start(text: Column, span: Column, n: Column) -> Column:
    """Start of occurrence n (from 0) of span, the last if there are fewer, -1 if none."""
    pieces = F.split(F.lower(text), F.concat(F.lit(r"\Q"), F.lower(span), F.lit(r"\E")), -1)
    k = F.least(n, F.size(pieces) - 2)
    before = F.aggregate(F.slice(pieces, 1, k + 1), F.lit(0), lambda s, p: s + F.length(p))
    return F.when((F.size(pieces) < 2) | (F.coalesce(span, F.lit("")) == ""), -1).otherwise(before + k * F.length(span))


def token_offsets(text: Column, pattern: str = TOKEN) -> Column:
    """Places of word tokens: each match's length, and those of the pieces between the matches."""
    text = F.coalesce(text, F.lit(""))
    running = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    size = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["skip"] + x["n"])
    bases = lambda blocks: F.aggregate(blocks, running, lambda s, x: F.struct((s["at"] + size(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    add = lambda s, x: F.struct((s["at"] + x["skip"] + x["n"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["skip"]).alias("start"), (s["at"] + x["skip"] + x["n"]).alias("end")))).alias("out"))
    # An array grows by copying, so places are made block by block, each from the characters before its block.
    cut = lambda steps: F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / BLOCK).cast("int")), lambda k: F.slice(steps, k * BLOCK + 1, BLOCK))
    placed = lambda blocks: F.flatten(F.zip_with(blocks, bases(blocks), lambda block, at: F.aggregate(block, start(at), add, lambda s: s["out"])))
    step = lambda b, t: F.struct(F.length(b).alias("skip"), F.length(t).alias("n"))
    # after the last token there is one more piece than tokens
    steps = F.filter(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), step), lambda x: x["n"].isNotNull())
    return once(steps, lambda steps: once(cut(steps), placed))


def once(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), where x is computed once however often then names it: inside a lambda a column's expression runs for every element."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def token_span(offsets: Column, start: Column, end: Column) -> Column:
    """First and last token that overlap [start, end), -1 and -1 if none does or the start is below 0."""
    at = F.filter(F.transform(offsets, lambda o, i: F.when((start >= 0) & (o["start"] < end) & (o["end"] > start), i)), lambda i: i.isNotNull())
    return F.struct(F.coalesce(F.array_min(at), F.lit(-1)).alias("first"), F.coalesce(F.array_max(at), F.lit(-1)).alias("last"))


def left(text: Column, start: Column, width: int = 100) -> Column:
    """Up to width characters before start; empty for a span that was not found."""
    return F.when(start < 0, "").otherwise(F.substring(text, F.greatest(start - width, F.lit(0)) + 1, F.least(start, F.lit(width))))


def right(text: Column, end: Column, width: int = 100) -> Column:
    return F.when(end < 0, "").otherwise(F.substring(text, end + 1, F.lit(width)))


def context(text: Column, start: Column, end: Column, width: int = 100) -> Column:
    """What stands around a span."""
    return F.concat_ws(" || ", left(text, start, width), right(text, end, width))


def coverage(spans: Column, n_tokens: Column) -> Column:
    """Of token spans (first, last): tokens covered, and those counted again for each span."""
    each = F.flatten(F.transform(F.filter(spans, lambda s: s["first"] >= 0), lambda s: F.sequence(s["first"], s["last"])))
    return F.struct(F.size(F.array_distinct(each)).alias("covered"), F.size(each).alias("counted"), (F.size(F.array_distinct(each)) / F.greatest(F.lit(1), n_tokens)).alias("share"))


def for_reconstruction(items: Column) -> Column:
    """Items by start (those without one last), longer first, then annotation id."""
    start = lambda x: F.when(x["start"] < 0, 10**9).otherwise(x["start"])
    size = lambda x: F.when(x["start"] < 0, 0).otherwise(x["end"] - x["start"])
    by_id = lambda x, y: F.when(x["annotation_id"] < y["annotation_id"], -1).when(x["annotation_id"] > y["annotation_id"], 1).otherwise(0)
    return F.array_sort(items, lambda x, y: F.when(start(x) != start(y), start(x) - start(y)).when(size(x) != size(y), size(y) - size(x)).otherwise(by_id(x, y)))


def same(a0, a1, b0, b1) -> Column:
    return (a0 >= 0) & (b0 >= 0) & (a0 == b0) & (a1 == b1)


def overlap(a0, a1, b0, b1) -> Column:
    return (a0 >= 0) & (b0 >= 0) & (F.greatest(a0, b0) < F.least(a1, b1))


def nested(a0, a1, b0, b1) -> Column:
    inside = ((a0 <= b0) & (a1 >= b1)) | ((b0 <= a0) & (b1 >= a1))
    return overlap(a0, a1, b0, b1) & inside & ~same(a0, a1, b0, b1)


def gap(a0, a1, b0, b1) -> Column:
    """Tokens between two token spans (ends included), 0 if they meet, null if one is unknown."""
    return F.when(F.least(a0, a1, b0, b1) < 0, None).when(a1 < b0, b0 - a1 - 1).when(b1 < a0, a0 - b1 - 1).otherwise(0)


def proximity(g: Column) -> Column:
    return F.coalesce(1 / (1 + g), F.lit(0.0))


def greedy(spans: Column) -> Column:
    """Longest spans first, then the earlier; a span that meets a chosen one is left out."""
    ordered = F.array_sort(spans, lambda x, y: F.when((y["end"] - y["start"]) != (x["end"] - x["start"]), (y["end"] - y["start"]) - (x["end"] - x["start"])).otherwise(x["start"] - y["start"]))
    free = lambda chosen, s: ~F.exists(chosen, lambda c: (c["start"] < s["end"]) & (s["start"] < c["end"]))
    picked = F.aggregate(ordered, F.slice(ordered, 1, 0), lambda chosen, s: F.when(free(chosen, s), F.concat(chosen, F.array(s))).otherwise(chosen))
    return F.array_sort(picked, lambda x, y: x["start"] - y["start"])
