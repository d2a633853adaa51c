"""Backward packets: what a reconstruction may see of a validated annotation, in order and sanitised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import jsonish, spans, text

# Keys that a packet must not carry, and the decisions that a schema may give.
BANNED = ("unmatched_language", "interpretation_units", "rationale", "combined_meaning", "backward_mapping_decision", "source_text", "raw_response")
DECISIONS = ("permit", "deny", "mixed", "unclear")


def items(annotations: DataFrame, inventory: DataFrame, sentence: str, span: str = "span", uid: str = "resolved_id") -> DataFrame:
    """Annotations with label_name, label_definition, place, and outcome: kept, full_sentence or empty."""
    known = inventory.select(F.col("union_element_id").alias("_u"), F.col("source_element_label").alias("label_name"), "source_model")
    s = text.collapsed(F.col(span))
    outcome = F.when((s == "") | (text.collapsed(F.col(uid)) == ""), "empty").when(full_sentence(F.col(span), F.col(sentence)), "full_sentence").otherwise("kept")
    met = annotations.join(known, F.col(uid) == F.col("_u"), "left").drop("_u").withColumn("outcome", outcome).withColumn("start", spans.located(F.col(sentence), s))
    return met.withColumn("end", F.when(F.col("start") < 0, -1).otherwise(F.col("start") + F.length(s)))


def full_sentence(span: Column, sentence: Column, ratio: float = 0.85) -> Column:
    """Whether a span is a sentence, or most of it: equal, or containing each other at the ratio of words."""
    flat = lambda x: F.trim(F.regexp_replace(F.lower(text.collapsed(x)), r"(?U)\W+", " "))
    a, b = flat(span), flat(sentence)
    words = lambda x: F.size(F.split(x, " "))
    return (a != "") & (b != "") & ((a == b) | ((words(a) >= ratio * words(b)) & (F.contains(b, a) | F.contains(a, b))))


def ordered(kept: DataFrame, key: list[str], span: str = "span", uid: str = "resolved_id") -> DataFrame:
    """One row per key: its kept items in the order of reconstruction, and counts."""
    item = F.struct(F.col("annotation_id"), text.collapsed(F.col(span)).alias("span_text"), F.col(uid).alias("label_id"), "label_name", "source_model", "start", "end")
    g = kept.groupBy(*key).agg(F.collect_list(F.when(F.col("outcome") == "kept", item)).alias("_i"), F.count_if(F.col("outcome") == "full_sentence").alias("n_full_sentence_spans_dropped"))
    put = F.transform(spans.for_reconstruction(F.col("_i")), lambda x, i: F.struct((i + 1).alias("sentence_order_index"), *(x[c].alias(c) for c in ("annotation_id", "span_text", "label_id", "label_name", "source_model", "start", "end"))))
    return g.withColumn("ordered_items", put).withColumn("n_eligible", F.size("_i")).drop("_i")


def links(raw_units: Column, valid_ids: Column) -> Column:
    """Relationship links of interpretation units (an array of variants) with two valid members or more."""
    ids = lambda u: F.filter(F.transform(F.coalesce(F.try_variant_get(u, "$.annotation_ids", "array<string>"), F.array().cast("array<string>")), text.collapsed), lambda x: F.array_contains(valid_ids, x))
    read = F.transform(raw_units, lambda u, i: F.struct(
        F.coalesce(F.nullif(text.collapsed(F.try_variant_get(u, "$.unit_id", "string")), F.lit("")), F.concat(F.lit("rel"), i + 1)).alias("relationship_id"),
        text.relationship(F.coalesce(F.try_variant_get(u, "$.relationship", "string"), F.lit(""))).alias("relationship_type"), ids(u).alias("annotation_ids")))
    return F.filter(read, lambda x: F.size(x["annotation_ids"]) >= 2)


def sentence_decision(raw: Column) -> Column:
    low = F.lower(text.collapsed(raw))
    return F.when(low.isin(*DECISIONS), low).otherwise("unclear")


def sanitised(annotations: DataFrame, fields: DataFrame, modifiers: DataFrame, key: list[str]) -> DataFrame:
    """Annotations (key, ann_idx, annotation_id, field_id, span, modifiers array<struct<name,value>>)
    against a schema's fields (field_id, field_name, allowed_modifiers) and modifiers (name,
    applies_to, allowed_values): unknown fields and empty spans are marked, ids repaired, and
    modifiers that are unknown, not allowed for the field or of another value are taken out."""
    f = fields.select(F.col("field_id").alias("_f"), "field_name", "allowed_modifiers")
    a = annotations.join(F.broadcast(f) if fields.isLocal() else f, F.col("field_id") == F.col("_f"), "left")
    ok = F.col("field_name").isNotNull() & (text.collapsed(F.col("span")) != "")
    a = a.withColumn("valid", ok)
    table = modifiers.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("applies_to", "allowed_values")))).alias("_m"))  # a schema's modifiers: one row
    a = a.crossJoin(table)
    rule = lambda m: F.try_element_at("_m", m["name"])
    free = lambda xs: (F.coalesce(F.size(xs), F.lit(0)) <= 0)
    fits = lambda m: rule(m).isNotNull() & (free(F.col("allowed_modifiers")) | F.array_contains("allowed_modifiers", m["name"])) & (free(rule(m)["applies_to"]) | F.array_contains(rule(m)["applies_to"], "all") | F.array_contains(rule(m)["applies_to"], F.col("field_name"))) & (free(rule(m)["allowed_values"]) | F.array_contains(rule(m)["allowed_values"], m["value"]))
    clean = F.filter("modifiers", lambda m: F.coalesce(fits(m), F.lit(False)))
    return a.select(*key, "ann_idx", "annotation_id", "field_id", "field_name", "span", "valid", clean.alias("modifiers"))


def banned_keys(packet: Column, banned=BANNED) -> Column:
    return F.filter(F.array(*map(F.lit, banned)), lambda k: F.contains(F.coalesce(packet, F.lit("")), k))


def messages(system: str, template: str, **values: Column) -> Column:
    """Chat messages: a fixed system text and a template whose {names} are replaced."""
    user = F.lit(template)
    for name, value in values.items():
        user = F.replace(user, F.lit("{" + name + "}"), value)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def reconstruction(parsed: Column, raw: Column) -> Column:
    """The first text under a known key of the parsed answer, else of the raw answer's JSON, else the raw answer."""
    keys = ("$.reconstructed_sentence", "$.reconstruction", "$.sentence", "$.text")
    return F.coalesce(F.nullif(jsonish.text_at(parsed, *keys), F.lit("")), F.nullif(jsonish.text_at(jsonish.parse(raw), *keys), F.lit("")), text.collapsed(raw))
