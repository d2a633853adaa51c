"""Walks through JSON of unknown shape, a level at a time: objects, lists and scalars with their path and document order.

A level's rows hold the JSON text of one object or list each. Its members are read twice by the JVM's parser, as
texts (which keep their order) and as variants (which know their kinds); those that are objects or lists are the next level.
Each level is written before the next is made, so a walk costs a job a level of nesting, and a plan does not grow.
Equal texts are walked once; they are written before they are looked at, as a text is often costly to make. Only texts that are no JSON for Spark (Python literals, repeated keys) pass through Python first.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import text
from spanloom.session import once, stored

_NESTED = ("OBJECT", "ARRAY")


@F.pandas_udf(T.StringType())
def _as_json(texts: pd.Series) -> pd.Series:
    """A Python literal, or JSON that only Python reads, as JSON; null where it is neither."""

    def read(x):
        for parser in (json.loads, ast.literal_eval):
            try:
                return json.dumps(parser(x), ensure_ascii=False, default=str)
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                continue
        return None

    return texts.map(read)


def texts_of(df: DataFrame, raw: Column) -> DataFrame:
    """id, raw: each text that starts with a bracket once, as JSON; the id is :func:`text_id` of the text as given."""
    bracket = lambda c, *those: F.substring(c, 1, 1).isin(*those)
    given = stored(df.select(once(F.trim(raw)).alias("s")).filter(bracket("s", "{", "[", "(")).distinct().select(text_id(F.col("s")).alias("id"), "s", F.try_parse_json("s").isNotNull().alias("json")), "texts")
    other = given.filter("NOT json").select("id", once(_as_json("s")).alias("raw"))
    return given.filter("json").select("id", F.col("s").alias("raw")).union(other.filter("raw IS NOT NULL")).filter(bracket("raw", "{", "["))


def text_id(raw: Column) -> Column:
    """The first 16 bytes of the SHA-256 of the trimmed text."""
    return F.substring(F.unhex(F.sha2(F.trim(raw), 256)), 1, 16)


def _members(raw: Column) -> Column:
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0).alias("kind")
    named = F.zip_with(F.map_entries(F.from_json(raw, "map<string,string>")), F.map_entries(F.from_json(raw, "map<string,variant>")), lambda t, v: F.struct(t["key"].alias("name"), t["value"].alias("text"), kind(v["value"])))
    listed = F.zip_with(F.from_json(raw, "array<string>"), F.from_json(raw, "array<variant>"), lambda t, v: F.struct(F.lit(None).cast("string").alias("name"), t.alias("text"), kind(v)))
    return F.when(raw.startswith("{"), named).otherwise(listed)


def containers(texts: DataFrame, wanted: Callable[[Column], Column] = lambda name: F.lit(False)) -> DataFrame:
    """Every object and list of id, raw: id, place (positions from the root, so that rows sort in document order),
    path (a.b[2]), under (whether a member with a wanted name is on the way), kind and members (name, text, kind)."""
    level = texts.select("id", F.array().cast("array<int>").alias("place"), F.lit("").alias("path"), F.lit(False).alias("under"), "raw")
    found = []
    while not found or not level.isEmpty():
        members = F.coalesce(_members(F.col("raw")), F.array().cast("array<struct<name:string,text:string,kind:string>>"))
        here = stored(level.select("id", "place", "path", "under", F.when(F.col("raw").startswith("{"), "OBJECT").otherwise("ARRAY").alias("kind"), members.alias("members")), "walk")
        found.append(here)
        each = here.select("id", "place", "path", "under", "kind", F.posexplode("members").alias("at", "m")).filter(F.col("m.kind").isin(*_NESTED))
        into = F.when(F.col("kind") == "ARRAY", F.concat("path", F.lit("["), "at", F.lit("]"))).when(F.col("path") == "", F.col("m.name")).otherwise(F.concat("path", F.lit("."), "m.name"))
        below = F.col("under") | F.coalesce(wanted(F.col("m.name")), F.lit(False))
        level = each.select("id", F.array_append("place", F.col("at")).alias("place"), into.alias("path"), below.alias("under"), F.col("m.text").alias("raw"))
    return reduce(DataFrame.union, found)


def plain(m: Column) -> Column:
    """A member's text: null for null, True and False as Python has them; an object or list is its JSON text."""
    return F.when(m["kind"] == "BOOLEAN", F.initcap(m["text"])).when(m["kind"] != "VOID", m["text"])


def first_of(members: Column, keys: tuple, norm=F.trim, any_case: bool = True) -> Column:
    """The first member, in document order, with one of the keys and a text that is not blank; else blank."""
    name = lambda m: F.lower(m["name"]) if any_case else m["name"]
    texts = F.filter(F.transform(F.filter(members, lambda m: name(m).isin(*keys)), lambda m: norm(plain(m))), lambda t: t != "")
    return F.coalesce(F.get(texts, F.lit(0)), F.lit(""))


def in_turn(members: Column, keys: tuple, norm=text.collapsed) -> Column:
    """The text of the first of the keys that has one that is not blank; else blank."""
    return F.coalesce(*(F.nullif(first_of(members, (k,), norm, any_case=False), F.lit("")) for k in keys), F.lit(""))


def per_text(rows: DataFrame, **lists: Column) -> DataFrame:
    """id and for each name the list of its values in document order (by place)."""
    gathered = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", *(c.alias(n) for n, c in lists.items())))).alias("_l"))
    return gathered.select("id", *(F.col("_l")[n].alias(n) for n in lists))


def keyed(df: DataFrame, raw: Column) -> DataFrame:
    """df with its trimmed text as _t, written once: a walk reads it for the texts and again for the rows that have them."""
    return stored(df.select("*", once(F.trim(raw)).alias("_t")), "keyed")


def under_keys(df: DataFrame, raw: Column, keys: tuple, available: str = "available", found: str = "found") -> DataFrame:
    """df with whether its JSON has one of the keys (in any spelling) at any depth, and the distinct texts below them, in document order."""
    wanted = lambda n: text.snake(n).isin(*keys)
    rows = keyed(df, raw)
    each = containers(texts_of(rows, F.col("_t")), wanted).select("id", "under", F.posexplode("members").alias("at", "m"), "place")
    own = F.coalesce(wanted(F.col("m.name")), F.lit(False))
    scalar = ~F.col("m.kind").isin(*_NESTED)
    said = F.nullif(text.collapsed(plain(F.col("m"))), F.lit(""))
    met = each.select("id", "place", "at", "m", "under", once(own).alias("own")).filter(F.col("own") | (scalar & F.col("under")))
    met = met.select("id", F.array_append("place", F.col("at")).alias("place"), "own", once(F.when(scalar, said)).alias("said"))
    in_order = F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("place", "said"))))["said"]
    texts = met.groupBy("id").agg(F.bool_or("own").alias("_has"), F.array_distinct(in_order).alias("_said"))
    joined = rows.withColumn("_id", text_id(F.col("_t"))).join(texts, F.col("_id") == F.col("id"), "left")
    return joined.select(*df.columns, F.coalesce("_has", F.lit(False)).alias(available), F.coalesce("_said", F.array().cast("array<string>")).alias(found))


def element_mentions(df: DataFrame, raw: Column, uid: str = "union_element_id") -> DataFrame:
    """A row for each object at any depth of a row's JSON that names an element: df's columns, place, path, the element, span_text,
    decision_value, annotation_id. Rows of df with the same JSON have the same ones."""
    rows = keyed(df, raw)
    objects = containers(texts_of(rows, F.col("_t"))).filter("kind = 'OBJECT'")
    m = F.col("members")
    named = F.try_element_at(F.transform(F.filter(m, lambda x: x["name"] == uid), plain), F.lit(-1))
    found = objects.select("id", "place", "path", "members", once(named).alias(uid)).filter((F.col(uid) != "") & ~F.col(uid).isin("0", "False", "[]", "{}"))
    read = found.select(
        "id", "place", "path", uid, in_turn(m, ("span_text", "evidence_span_text")).alias("span_text"), in_turn(m, ("value", "decision", "sentence_decision")).alias("decision_value"), in_turn(m, ("annotation_id",)).alias("annotation_id"),
    )
    return rows.withColumn("_id", text_id(F.col("_t"))).join(read, F.col("_id") == F.col("id")).drop("_id", "_t", "id")
