"""Semi-structured text: tolerant JSON, annotation micro-syntax, lists in strings."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unfenced(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"(?s)^```[a-zA-Z]*\s*|\s*```$", ""))


def json_text(x: Column) -> Column:
    """The text without its fence if it is JSON, else its outermost braces, else brackets, else null."""
    s = unfenced(x)
    part = lambda p: F.nullif(F.regexp_extract(s, p, 0), F.lit(""))
    good = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(good(F.nullif(s, F.lit(""))), good(part(r"(?s)\{.*\}")), good(part(r"(?s)\[.*\]")))


def parse(x: Column) -> Column:
    """Variant of the text without its fence, else of its outermost braces, else brackets, else null."""
    s = unfenced(x)
    part = lambda p: F.try_parse_json(F.nullif(F.regexp_extract(s, p, 0), F.lit("")))
    return F.coalesce(F.try_parse_json(F.nullif(s, F.lit(""))), part(r"(?s)\{.*\}"), part(r"(?s)\[.*\]"))


def parse_object(x: Column) -> Column:
    v = parse(x)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


@F.pandas_udf(T.StringType())
def balanced(texts: pd.Series) -> pd.Series:
    """The first balanced object that parses, strings and escapes respected; regular expressions cannot say this."""

    def first(text):
        decoder = json.JSONDecoder()
        at = (text or "").find("{")
        while at >= 0:
            try:
                return json.dumps(decoder.raw_decode(text, at)[0])
            except ValueError:
                at = text.find("{", at + 1)
        return None

    return texts.map(first)


def text_at(v: Column, *paths: str) -> Column:
    """The first path that holds a non-empty text."""
    return F.coalesce(*(F.nullif(F.trim(F.try_variant_get(v, p, "string")), F.lit("")) for p in paths), F.lit(""))


def items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def annotations(v: Column) -> Column:
    """span, label, decision of each annotation, whatever its keys are called."""
    return F.transform(items(v, "$.annotations"), lambda a: F.struct(
        text_at(a, "$.span_text", "$.span", "$.text").alias("span"), text_at(a, "$.union_element_id", "$.element_id", "$.label").alias("label"), F.lower(text_at(a, "$.decision", "$.decision_value")).alias("decision")))


def bracketed(x: Column) -> Column:
    """span, label, decision of each ``span text [LABEL] (decision)``."""
    pattern = r"([^\[\]()]*)\[([^\]]*)\]\s*(?:\(([^)]*)\))?"
    groups = [F.regexp_extract_all(x, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("s", "l", "d"), strict=True))), lambda a: F.struct(F.trim(a["s"]).alias("span"), F.trim(a["l"]).alias("label"), F.lower(F.trim(a["d"])).alias("decision")))


def flattened(x: Column) -> Column:
    """Key and text value of a JSON object's members."""
    return F.coalesce(F.from_json(unfenced(x), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def _distinct_filled(x: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(x, lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != ""))


def csv_rows(x: Column) -> Column:
    """The cells of each line of comma-separated text; quoted cells may hold commas, not line ends."""
    lines = F.filter(F.split(unfenced(x), r"\r?\n"), lambda l: F.trim(l) != "")  # noqa: E741
    cell = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'
    bare = lambda c: F.trim(F.when(c.startswith('"'), F.replace(F.substring(c, 2, F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.transform(lines, lambda l: F.transform(F.regexp_extract_all(l, F.lit(cell), F.lit(1)), bare))  # noqa: E741


def csv_annotations(x: Column, source: Column) -> Column:
    """span, label, decision of each line of comma-separated text: the span is the longest cell that the
    source has and that is not nearly all of it, the decision the last cell if it is one, the label
    the cell before it or the last."""
    decided = lambda r: F.lower(F.element_at(r, -1)).isin("permit", "deny", "permission", "prohibition")
    inside = lambda r: F.filter(r, lambda c: (F.length(c) > 2) & F.contains(F.lower(source), F.lower(c)) & (F.length(c) < 0.85 * F.length(source)))
    longest = lambda r: F.array_max(F.transform(inside(r), lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))["c"]
    rows = F.filter(csv_rows(x), lambda r: F.size(r) >= 2)
    read = F.transform(rows, lambda r: F.struct(longest(r).alias("span"), F.when(decided(r), F.element_at(r, -2)).otherwise(F.element_at(r, -1)).alias("label"), F.when(decided(r), F.lower(F.element_at(r, -1))).otherwise("").alias("decision")))
    return F.filter(read, lambda a: a["span"].isNotNull() & (a["label"] != "") & (a["label"] != a["span"]))


_HEADER = ("annotation", "duo_label", "ico_label", "odrl_label", "fhir_label")


def forward_counts(raw: Column, roles: list[str]) -> Column:
    """n, n_labels, parse_ok of an answer: its annotations, else the filled roles of its provisions, else
    the lines of its comma-separated text."""
    v = parse(raw)
    anns = F.coalesce(F.try_variant_get(v, "$.annotations", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    names = _distinct_filled(F.transform(anns, lambda a: text_at(a, "$.field_name", "$.field_id", "$.cluster_id", "$.union_element_id", "$.label", "$.element_id", "$.id")))
    provs = items(v, "$.provisions")

    def of(p, role):
        one = F.try_variant_get(p, f"$.{role}", "variant")
        if role == "decision":
            return F.when(text_at(one, "$.value", "$.evidence_span_text") != "", 1).otherwise(0)
        many = F.try_variant_get(p, f"$.{role}", "array<string>")
        return F.when(many.isNotNull(), F.size(F.filter(many, lambda x: F.trim(x) != ""))).otherwise(F.when(F.trim(F.coalesce(F.try_variant_get(p, f"$.{role}", "string"), F.lit(""))) != "", 1).otherwise(0))

    filled = lambda role: lambda p: of(p, role)
    per = {r: F.aggregate(F.transform(provs, filled(r)), F.lit(0), lambda s, x: s + x) for r in roles}
    n_roles, kinds = sum(per.values(), F.lit(0)), sum((F.when(c > 0, 1).otherwise(0) for c in per.values()), F.lit(0))
    rows = csv_rows(raw)
    head = F.exists(F.element_at(rows, 1), lambda c: F.lower(c).isin(*_HEADER))
    body = F.when(F.size(rows) == 0, rows).when(head, F.slice(rows, 2, F.greatest(F.lit(1), F.size(rows)))).otherwise(rows)
    last = lambda r: F.when(F.lower(F.element_at(r, -1)).isin("permit", "deny", "permission", "prohibition"), F.element_at(r, -2)).otherwise(F.element_at(r, -1))
    labels = _distinct_filled(F.transform(F.filter(body, lambda r: F.size(r) >= 3), last))
    out = lambda n, k, ok: F.struct(n.alias("n"), k.alias("n_labels"), F.lit(ok).alias("parse_ok"))
    return F.when(F.size(anns) > 0, out(F.size(anns), F.size(names), True)).when(n_roles > 0, out(n_roles, kinds, True)).when(unfenced(raw) == "", out(F.lit(0), F.lit(0), False)).otherwise(out(F.size(body), F.size(labels), False))


def provisions(raw: Column) -> Column:
    """role, span and provision_id of every item of an answer's provisions; lists give an item each."""
    provs = items(parse(raw), "$.provisions")
    span = lambda x: text_at(x, "$.evidence_span_text", "$.span_text", "$.text", "$.value")
    as_text = lambda x: F.coalesce(F.nullif(span(x), F.lit("")), F.when(F.schema_of_variant(x) == "STRING", F.trim(F.try_variant_get(x, "$", "string"))), F.lit(""))

    def of(p):
        members = F.map_entries(F.coalesce(F.try_variant_get(p, "$", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>")))
        used = F.filter(members, lambda m: ~m["key"].isin("provision_id", "provenance"))
        # a decision comes first, then the roles by name
        ordered = F.array_sort(used, lambda a, b: F.when((a["key"] == "decision") & (b["key"] != "decision"), -1).when((b["key"] == "decision") & (a["key"] != "decision"), 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        each = lambda m: F.transform(F.coalesce(F.try_variant_get(m["value"], "$", "array<variant>"), F.array(m["value"])), lambda x: F.struct(m["key"].alias("role"), as_text(x).alias("span"), text_at(p, "$.provision_id").alias("provision_id")))
        return F.flatten(F.transform(ordered, each))

    return F.filter(F.flatten(F.transform(provs, of)), lambda x: x["span"] != "")


def listed(x: Column) -> Column:
    """A JSON list, or parts split at ; | and comma."""
    parts = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[;|,]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.trim(x).startswith("["), F.coalesce(F.from_json(x, "array<string>"), parts)).otherwise(parts)
