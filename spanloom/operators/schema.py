"""Reduced schemas: evidence cards, their flags, selected fields, modifiers and evidence ids."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.relational import most_common

# Words that name models and decisions rather than content.
ARTIFACTS = "permit deny permission prohibition obligation mixed unclear ico fhir duo odrl provision provisions directive role actor action data consent rule".split()
# Forms of evidence ids in running text, and the source models.
EVIDENCE_ID = r"(?i)(?:C\d{3,}|SG[_-]?\d+|field[_-]?\d+|cluster[_-]?\d+)"
SOURCE_MODELS = ("ICO", "DUO", "ODRL", "FHIR", "FHIR_Consent")


def evidence_ids(listed: list[Column], prose: list[Column]) -> Column:
    """Ids given in list columns, then those met in prose; blanks and repeats go, order stays."""
    given = F.flatten(F.array(*(F.coalesce(F.transform(c, lambda x: F.trim(x)), F.array().cast("array<string>")) for c in listed)))
    met = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EVIDENCE_ID), 0) for c in prose)))
    return F.array_distinct(F.filter(F.concat(given, met), lambda x: x != ""))


def models_named(text: Column, models=SOURCE_MODELS) -> Column:
    """The models whose name stands in a text as a word, in order of models."""
    return F.filter(F.array(*map(F.lit, models)), lambda m: F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit(r"(?i)\b"), m, F.lit(r"\b"))))


def modifier_allowed(allowed: Column, modifier: Column) -> Column:
    """An empty or missing list allows every modifier; blanks in it do not count."""
    named = F.filter(F.transform(F.coalesce(allowed, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(named) == 0) | F.array_contains(named, modifier)


def term_profile(df: DataFrame, by: str, suggested: str, tokens: str, k: int) -> DataFrame:
    """by, terms: the first k suggested terms (of several lists the least), or the k most frequent of tokens where none is
    suggested (ties by name), without artifacts; sorted."""
    often = most_common(df.select(by, F.explode(tokens).alias("t")), [by], "t", k)
    ordered = often.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "t")))["t"].alias("often"))
    given = df.groupBy(by).agg(F.min(suggested).alias("given"))
    chosen = F.when(F.size(F.coalesce("given", F.array().cast("array<string>"))) > 0, F.slice("given", 1, k)).otherwise(F.col("often"))
    keep = F.filter(chosen, lambda t: (t != "") & ~t.isin(ARTIFACTS))
    return given.join(ordered, by, "left").select(by, F.array_sort(F.array_distinct(F.coalesce(keep, F.array().cast("array<string>")))).alias("terms"))


def cards(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """One card a cluster: its nodes (most mentions first), near-equivalence edges, unsafe-merge
    warnings, support and quality flags.

    nodes: by, node, source_model, llm, form, n_mentions. edges: a, b, relationship."""
    per_node = nodes.groupBy(by, "node").agg(F.sum("n_mentions").alias("n_mentions"))
    listed = per_node.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n_mentions")).alias("order"), "node", "n_mentions"))).alias("l"))
    listed = listed.select(by, F.transform("l", lambda x: F.struct(x["node"].alias("node"), x["n_mentions"].alias("n_mentions"))).alias("nodes"))
    support = nodes.groupBy(by).agg(F.sum("n_mentions").alias("support"), F.countDistinct("source_model").alias("n_source_models"), F.countDistinct("llm").alias("n_llms"), F.countDistinct("form").alias("n_forms"))
    home = nodes.select(by, "node").distinct()
    ends = edges.join(home.withColumnRenamed("node", "a"), "a").join(home.withColumnRenamed("node", "b").withColumnRenamed(by, "_b"), "b")
    pair = F.struct("a", "b")
    inner = ends.filter(F.col(by) == F.col("_b")).groupBy(by).agg(F.array_sort(F.collect_set(F.when(F.col("relationship") == "near_equivalent", pair))).alias("equivalence_edges"))
    unsafe = ends.filter(F.col("relationship") == "unsafe_to_merge").select(F.explode(F.array_distinct(F.array(by, "_b"))).alias(by), pair.alias("p")).groupBy(by).agg(F.array_sort(F.collect_set("p")).alias("unsafe_merge_warnings"))
    card = support.join(listed, by).join(inner, by, "left").join(unsafe, by, "left")
    for c in ("equivalence_edges", "unsafe_merge_warnings"):
        card = card.withColumn(c, F.coalesce(c, F.array().cast(card.schema[c].dataType)))
    return card.withColumn("quality_flags", quality_flags())


def quality_flags() -> Column:
    # Names of flags.
    rules = (
        ("single_source_model_support", F.col("n_source_models") <= 1), ("single_llm_support", F.col("n_llms") <= 1), ("single_form_support", F.col("n_forms") <= 1),
        ("unsafe_merge_warning_present", F.size("unsafe_merge_warnings") > 0), ("singleton_or_no_explicit_equivalence_edge", F.size("equivalence_edges") == 0), ("large_seed_cluster_review_boundary", F.size("nodes") > 5),
    )
    return F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in rules)))


def emit(selected: DataFrame, by: str, order: list[Column], **fields: Column) -> DataFrame:
    """by, n_fields, schema_json: the selected fields of each fold as one JSON document."""
    field = F.struct(*(c.alias(n) for n, c in fields.items()))
    listed = F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), field.alias("f"))))["f"]
    return selected.groupBy(by).agg(F.count("*").alias("n_fields"), F.to_json(F.struct(F.first(by).alias("schema_id"), listed.alias("fields"))).alias("schema_json"))


def evaluation_rows(rows: DataFrame, held_out: DataFrame, form: str, sentence: str, order: str, split: str = "all") -> DataFrame:
    """One row a form and sentence (the first by order), without empty sentences, with eval_split
    (heldout if the form is in held_out, else training) and eval_row_id; split keeps one of the two."""
    first = rows.filter(F.length(F.trim(sentence)) > 0).groupBy(form, sentence).agg(F.min(order).alias(order))
    known = held_out.select(F.col(form).alias("_form")).distinct()
    out = first.join(known, F.col("_form").eqNullSafe(F.col(form)), "left")
    out = out.withColumn("eval_split", F.when(F.col("_form").isNotNull(), "heldout").otherwise("training")).drop("_form")
    out = out.withColumn("eval_row_id", F.substring(F.sha1(F.concat_ws("||", F.coalesce(form, F.lit("")), sentence)), 1, 12))
    return out if split == "all" else out.filter(F.col("eval_split") == split)


def field_rows(path: str, spark) -> DataFrame:
    """The fields of a schema file (JSON), one row each; unknown keys are ignored."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("fields") or []
    rows = [(str(x.get("field_id", "")), str(x.get("name", "")), str(x.get("definition", "")), [str(m) for m in x.get("allowed_modifiers") or []]) for x in found]
    return spark.createDataFrame(rows, "field_id string, name string, definition string, allowed_modifiers array<string>")
