"""Evidence units: what a mapping text says, whatever its shape, as rows; their graph and summaries."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import cues, text
from spanloom.operators import walks
from spanloom.operators.evaluation import stable_id
from spanloom.session import once, stored

# Keys under which mappings keep identifiers, labels and texts.
ID_KEYS = ("id", "node_id", "concept_id", "term_id", "code", "uri", "iri", "class_id", "element_id")
LABEL_KEYS = ("label", "name", "term", "title", "class", "predicate", "property", "element", "concept", "node")
TEXT_KEYS = ("text", "phrase", "span", "value", "content", "verbatim", "sentence", "description")
_GROUP_OF = {k: i for i, keys in enumerate((ID_KEYS, LABEL_KEYS, TEXT_KEYS)) for k in keys}
LONGEST, SHORTEST, LINES = 240, 4, 50
#: What goes at a line's beginning: any signs and digits of a list, or a number only with its dot or bracket.
LIST_SIGNS, LIST_MARKS = r"^[\s\-*•\d.)]+", r"^(?:[\s\-*•.)]|\d+[.)](?!\S))+"
_UNIT = "struct<source_element_id:string,label:string,span:string,method:string,path:string>"
#: Texts whose units a task holds at once.
_TEXTS = 256
_HALF_PAIR = re.compile(r"\\u[dD][89a-fA-F]")


class _Other(Exception):
    """A text whose values the JVM writes in another form than Python."""


def _other(_):
    raise _Other


def _shown(v) -> str:
    """As the level walk shows a member, without blanks around it."""
    if v is None:
        return ""
    if isinstance(v, (dict, list)):
        v = json.dumps(v, ensure_ascii=False, separators=(",", ":"))
        if "\\u00" in v:
            raise _Other
    return str(v).strip(" ")


def _walked(root) -> list[tuple[str, str, str, str]]:
    """id, label, span and path of the node-like objects in a parsed text, in document order."""
    out, todo = [], [("", root)]
    while todo:
        path, x = todo.pop()
        if isinstance(x, list):
            todo += [(f"{path}[{i}]", v) for i, v in enumerate(x) if isinstance(v, (dict, list))][::-1]
            continue
        first, below = ["", "", ""], []
        for k, v in x.items():
            which = _GROUP_OF.get(k.lower())
            if which is not None and not first[which]:
                first[which] = _shown(v)
            if isinstance(v, (dict, list)):
                below.append((f"{path}.{k}" if path else k, v))
        todo += below[::-1]
        i, label, span = first
        if i or label or span:
            out.append((i, label or span or i, span or label or i, path))
    return out


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of each text that is JSON for Python and shown by it as by the JVM, so without floats; else none, and the text."""
    decoder, kept = json.JSONDecoder(parse_float=_other, parse_constant=_other), sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(1000)  # the JVM's parser reads no longer ones
    try:
        for batch in batches:
            for lo in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(lo, _TEXTS)
                left, found, at = [], [], [0]
                for t in part.column("_s").to_pylist():
                    rest = None
                    if t and t[0] in "{[(":
                        try:
                            if _HALF_PAIR.search(t):
                                raise _Other
                            found += _walked(decoder.decode(t))
                        except (_Other, ValueError, RecursionError):
                            rest = t
                    left.append(rest)
                    at.append(len(found))
                columns = [pa.array(x, pa.string()) for x in (zip(*found, strict=True) if found else [[]] * 4)]
                fields = [*columns[:3], pa.array(["json_object"] * len(found), pa.string()), columns[3]]
                units = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(fields, ["source_element_id", "label", "span", "method", "path"]))
                keep = part.schema.names[:-1]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), pa.array(left, pa.string()), units], [*keep, "_s", "units"])
    finally:
        sys.set_int_max_str_digits(kept)


def units_beside(df: DataFrame, raw: Column, *keep: str) -> DataFrame:
    """The columns to keep and units, for each row whose text has some: node-like objects of JSON or of a Python literal at any depth, in
    document order. A text is read in one pass where it is; only those that Python cannot show as the JVM does are walked level by level."""
    given = df.select(*keep, F.trim(raw).alias("_s"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    read = stored(given.mapInArrow(_read_whole, f"{kinds}, units array<{_UNIT}>"), "units")
    whole, other = read.filter(F.size("units") > 0).select(*keep, "units"), read.filter("_s IS NOT NULL").select(*keep, "_s")
    if other.isEmpty():
        return whole
    walked = _level_units(other, F.col("_s")).select(F.col("id").alias("_id"), "units")
    return whole.union(other.join(walked, walks.text_id(F.col("_s")) == F.col("_id")).select(*keep, "units"))


def json_units(df: DataFrame, raw: Column) -> DataFrame:
    """id (of the text), units: those of :func:`units_beside` for each text once."""
    texts = df.select(once(F.trim(raw)).alias("_t")).filter(F.substring("_t", 1, 1).isin("{", "[", "(")).distinct()
    return units_beside(texts.select(walks.text_id(F.col("_t")).alias("id"), "_t"), F.col("_t"), "id")


def _level_units(df: DataFrame, raw: Column) -> DataFrame:
    objects = walks.containers(walks.texts_of(df, raw)).filter("kind = 'OBJECT'")
    read = objects.select("id", "place", "path", once(F.struct(*(walks.first_of(F.col("members"), keys).alias(n) for n, keys in (("i", ID_KEYS), ("l", LABEL_KEYS), ("s", TEXT_KEYS))))).alias("u"))
    i, label, span = F.col("u.i"), F.col("u.l"), F.col("u.s")
    either = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c))
    unit = F.struct(i.alias("source_element_id"), either(label, span, i).alias("label"), either(span, label, i).alias("span"), F.lit("json_object").alias("method"), F.col("path").alias("path"))
    return walks.per_text(read.filter((i != "") | (label != "") | (span != "")), units=unit)


def _unit(i, label, span, method) -> Column:
    return F.struct(i.alias("source_element_id"), label.alias("label"), span.alias("span"), F.lit(method).alias("method"), F.lit("").alias("path"))


def with_units(rows: DataFrame, mapping: str, model: str, original: str, bullet: str = LIST_SIGNS) -> DataFrame:
    """Adds _units: of a mapping its JSON objects, identifiers of known families and lines; else the
    mapping's beginning, else the original's. Each (id, label, span) once, case aside. Steps are
    columns of their own, so that none is evaluated twice."""
    df = rows.withColumn("_s", F.trim(F.coalesce(mapping, F.lit(""))))
    s = F.col("_s")
    ids = F.transform(text.id_families(s, text.ID_FAMILIES), lambda x: _unit(x, x, x, "regex_id"))
    bare = F.transform(F.split(s, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.trim(F.regexp_replace(x, bullet, "")))
    lines = F.slice(F.filter(bare, lambda x: (F.length(x) >= SHORTEST) & (F.length(x) <= LONGEST)), 1, LINES)
    walked = json_units(rows, F.coalesce(mapping, F.lit(""))).select(F.col("id").alias("_id"), F.col("units").alias("_u"))
    df = df.join(walked, walks.text_id(s) == F.col("_id"), "left")
    df = df.withColumns({"_j": F.coalesce("_u", F.array().cast(walked.schema["_u"].dataType)), "_x": F.concat(ids, F.transform(lines, lambda x: _unit(F.lit(""), x, x, "mapping_line")))})
    named = F.coalesce(F.nullif(F.col(model), F.lit("")), F.lit("mapping_text"))
    rest = F.when((F.size("_x") == 0) & (s != ""), F.array(_unit(F.lit(""), named, F.substring(s, 1, LONGEST), "mapping_text_fallback"))).otherwise(F.col("_x"))
    df = df.withColumn("_every", F.filter(F.concat("_j", rest), lambda u: (u["source_element_id"] != "") | (u["label"] != "") | (u["span"] != "")))
    key = lambda u: F.lower(F.concat_ws("\x01", u["source_element_id"], u["label"], u["span"]))
    empty = F.struct(F.array().cast("array<string>").alias("keys"), F.slice("_every", 1, 0).alias("out"))
    add = lambda s, u: F.when(F.array_contains(s["keys"], key(u)), s).otherwise(F.struct(F.array_append(s["keys"], key(u)).alias("keys"), F.array_append(s["out"], u).alias("out")))
    df = df.withColumn("_once", F.aggregate("_every", empty, add, lambda s: s["out"]))
    fallback = F.array(_unit(F.lit(""), F.col(model), F.substring(F.col(original), 1, LONGEST), "original_text_fallback"))
    return df.select(*rows.columns, F.when(F.size("_once") > 0, F.col("_once")).otherwise(fallback).alias("_units"))


def evidence(rows: DataFrame, dictionary: dict[str, list[str]], mapping: str = "forward_mapping", model: str = "information_model", original: str = "original_text", reconstructed: str = "reconstructed_text", key: str = "roundtrip_id", bullet: str = LIST_SIGNS) -> DataFrame:
    """One row per unit: evidence_unit_id, source_element_id and _key, label, span, unit_text, method, path, cue_groups."""
    u = with_units(rows, mapping, model, original, bullet).select(*rows.columns, F.posexplode("_units").alias("unit", "_x")).select(*rows.columns, "unit", "_x.*")
    parts = F.concat_ws(" | ", *(F.nullif(F.col(c), F.lit("")) for c in ("span", "label", "source_element_id", model)))
    u = u.withColumn("unit_text", parts)
    eid = F.concat(F.lit("ev_"), stable_id(F.col(key), F.col("unit").cast("string"), F.col("unit_text")))
    derived = F.concat(F.lit("derived:"), stable_id(F.col(model), F.col("label"), F.col("span")))
    source = F.coalesce(F.nullif(F.col("source_element_id"), F.lit("")), derived)
    groups = cues.groups_in(F.concat_ws(" ", "span", "label", original, reconstructed), dictionary)
    return u.withColumns({"evidence_unit_id": eid, "source_element_key": source, "cue_groups": groups})


def edges(ev: DataFrame, key: str = "roundtrip_id", sentence: str = "sentence_id", model: str = "information_model", llm: str = "llm") -> DataFrame:
    """source, target, edge_type, evidence_unit_id: eight kinds of edges, in one pass over the units."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    trip, sent, mod, gen = name("roundtrip", key), name("sentence", sentence), name("source_model", model), name("llm", llm)
    element = F.concat(F.lit("source_element:"), F.col(model), F.lit(":"), F.col("source_element_key"))
    e = F.col("evidence_unit_id")
    one = lambda a, b, kind, of=e: F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("edge_type"), of.alias("evidence_unit_id"))
    first = [one(trip, sent, "has_sentence", F.lit("")), one(trip, mod, "uses_information_model", F.lit("")), one(trip, gen, "generated_by_llm", F.lit(""))]
    own = [one(e, trip, "evidence_for_roundtrip"), one(e, sent, "evidence_for_sentence"), one(e, element, "maps_to_source_element"), one(element, mod, "belongs_to_source_model")]
    cue = F.transform("cue_groups", lambda g: one(e, F.concat(F.lit("cue_group:"), g), "matches_cue_group"))
    every = F.concat(F.when(F.col("unit") == 0, F.array(*first)).otherwise(F.slice(F.array(*first), 1, 0)), F.array(*own), cue)
    return ev.select(key, F.inline(every))


def frequencies(ev: DataFrame, model: str = "information_model", sentence: str = "sentence_id", label: str = "meaning_preserved") -> DataFrame:
    return ev.groupBy(model, "source_element_key", "label").agg(F.count("*").alias("n_evidence_units"), F.countDistinct(sentence).alias("n_sentences"), F.avg(label).alias("preserved_rate"))


def cue_frequencies(ev: DataFrame, label: str = "meaning_preserved") -> DataFrame:
    return ev.select(F.explode("cue_groups").alias("cue_group"), label).groupBy("cue_group").agg(F.count("*").alias("n"), F.avg(label).alias("preserved_rate"))
