"""Mentions: one row per usable annotation of a round trip, and an audit of those left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import jsonish, spans, text
from spanloom.operators.evaluation import stable_id

# Labels that are no annotations, and labels of whole sentences.
RESERVED_LABELS = ("unmatched_language", "unmatched", "interpretation_units", "rationale", "raw_response", "raw reconstruction text")
SENTENCE_LABELS = (
    "odrl::rule_testsentence", "rule_testsentence", "fhir_consent::consent.provision.type", "fhir::consent.provision.type", "consent.provision.type",
    "fhir_consent::consent.decision", "fhir::consent.decision", "consent.decision", "duo::duo.decision", "ico::ico.decision",
)
POSITIVE = ("1", "1.0", "true", "yes", "y", "preserved", "pass", "passed", "meaning preserved")
NEGATIVE = ("0", "0.0", "false", "no", "n", "failed", "fail", "not preserved")


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(text.collapsed(c.cast("string")), F.lit("")) for c in columns), F.lit(""))


def identities(rows: DataFrame, forms: list[str], sentences: list[str], roundtrips: list[str], sentence: str, row_number: str) -> DataFrame:
    """Adds form, sentence_key (or a hash of the text) and roundtrip_key (or the row's number)."""
    there = lambda names: [F.col(c) for c in names if c in rows.columns]
    form = F.coalesce(*(F.nullif(text.form_key(first_filled(c)), F.lit("")) for c in there(forms)), F.lit(""))
    key = F.coalesce(F.nullif(first_filled(*there(sentences)), F.lit("")), F.concat(F.lit("SENT_"), stable_id(text.collapsed(F.col(sentence)))))
    trip = F.coalesce(F.nullif(first_filled(*there(roundtrips)), F.lit("")), F.concat(F.lit("ROW_"), F.col(row_number) + 2))
    return rows.withColumns({"form": form, "sentence_key": key, "roundtrip_key": trip})


def preserved(x: Column) -> Column:
    s = F.lower(text.collapsed(x.cast("string")))
    return F.when(s.isin(*POSITIVE), 1).when(s.isin(*NEGATIVE), 0).otherwise(-1)


def annotations(rows: DataFrame, raw: str, information_model: str) -> DataFrame:
    """One row per annotation of a row's JSON or bracketed text: ann_idx (from 1), span, label,
    element_id, decision, and reason (empty: usable). A text that only says NA gives one row."""
    v = jsonish.parse(F.col(raw))
    listed = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    listed = F.coalesce(listed, F.try_variant_get(v, "$.annotations", "array<variant>"), F.try_variant_get(v, "$.valid_annotations", "array<variant>"))
    pick = lambda a, *names: text.collapsed(jsonish.text_at(a, *(f"$.{n}" for n in names)))
    read = F.transform(listed, lambda a: F.struct(
        pick(a, "span_text", "evidence_span_text", "cue_span_text", "span", "text", "value").alias("span"),
        pick(a, "source_element_label", "label_name", "field_name", "label", "element_label", "name").alias("label"),
        pick(a, "source_element_id", "union_element_id", "label_id", "element_id", "field_id", "id").alias("element_id"),
        F.lower(pick(a, "decision_value", "decision", "sentence_decision", "polarity")).alias("decision"),
    ))
    compact = F.transform(jsonish.bracketed(text.collapsed(F.col(raw))), lambda a: F.struct(a["span"].alias("span"), a["label"].alias("label"), F.lit("").alias("element_id"), a["decision"].alias("decision")))
    nothing = F.array(F.struct(text.collapsed(F.col(raw)).alias("span"), text.collapsed(F.col(raw)).alias("label"), F.lit("").alias("element_id"), F.lit("").alias("decision")))
    found = F.when(F.size(read) > 0, read).when(F.size(compact) > 0, compact).when(text.is_na(F.col(raw), text.MENTION_NA), nothing).otherwise(F.slice(nothing, 1, 0))
    each = rows.select("*", F.posexplode(found).alias("_i", "_a")).select(*rows.columns, (F.col("_i") + 1).alias("ann_idx"), "_a.*")
    key = F.when(F.col("label") != "", F.col("label")).otherwise(F.col("element_id"))
    na = lambda c: text.is_na(c, text.MENTION_NA)
    low = F.lower(key)
    reason = (
        F.when(na(F.col("span")) & na(key), "na_only").when((F.col("span") == "") | (key == ""), "empty_span_or_label").when(low.isin(*RESERVED_LABELS), "reserved_non_annotation_content")
        .when(low.isin(*SENTENCE_LABELS) | F.concat(F.lower(information_model), F.lit("::"), low).isin(*SENTENCE_LABELS), "sentence_level_label").otherwise("")
    )
    return each.withColumn("key", key).withColumn("reason", reason)


def audit(rows: DataFrame, annotated: DataFrame, key: str, label: str) -> DataFrame:
    """key, ann_idx, span, key, reason of annotations that are left out, and a row (ann_idx null) for
    each round trip that was marked preserved but has no usable annotation."""
    bad = annotated.filter("reason <> ''").select(key, "ann_idx", "span", F.col("key").alias("label"), "reason", F.lit(False).alias("row_level"))
    per = annotated.groupBy(key).agg(F.count_if(F.col("reason") == "").alias("good"), F.count_if(F.col("reason") == "na_only").alias("na"), F.count("*").alias("n"))
    whole = rows.filter(preserved(F.col(label)) == 1).select(key).join(per, key, "left").filter("coalesce(good, 0) = 0")
    why = F.when((F.col("n") > 0) & (F.col("na") == F.col("n")), "positive_preserved_but_solely_na_llm_tags").otherwise("positive_preserved_but_no_valid_span_annotations")
    return bad.unionByName(whole.select(key, F.lit(None).cast("int").alias("ann_idx"), F.lit("").alias("span"), F.lit("").alias("label"), why.alias("reason"), F.lit(True).alias("row_level")))


def mentions(annotated: DataFrame, key: str, sentence: str, label: str) -> DataFrame:
    """Usable annotations with their place (the n-th mention of a span is looked for at its n-th
    occurrence), token span, context, canonical span, head, role, polarity and validity."""
    usable = annotated.filter("reason = ''")
    nth = F.row_number().over(Window.partitionBy(key, F.lower("span")).orderBy("ann_idx")) - 1
    s, span = F.col(sentence), F.col("span")
    placed = usable.withColumn("occurrence", nth).withColumn("span_start", spans.nth_start(s, span, F.col("occurrence")))
    placed = placed.withColumn("span_end", F.when(F.col("span_start") < 0, -1).otherwise(F.col("span_start") + F.length("span")))
    start, end = F.col("span_start"), F.col("span_end")
    placed = placed.withColumn("_t", spans.token_span(spans.token_offsets(s), start, end))
    terms, around = text.term_tokens(span), F.concat_ws(" ", span, spans.left(s, start), spans.right(s, end))
    validity = F.when(preserved(F.col(label)) == 1, "valid_positive").when(preserved(F.col(label)) == 0, "invalid_negative").otherwise("unlabeled")
    return placed.withColumns({
        "token_start": F.col("_t.first"), "token_end": F.col("_t.last"), "local_context": text.collapsed(spans.context(s, start, end)),
        "span_canonical": F.array_join(terms, " "), "span_head": F.coalesce(F.try_element_at(terms, F.lit(-1)), F.lit("")), "span_token_count": F.size(terms),
        "role_signature": text.role(text.term_tokens(around, ()), text.ROLES), "linguistic_polarity": text.polarity(span), "validity": validity,
    }).drop("_t")


def with_split(rows: DataFrame, folds: DataFrame, form: str, test_fold: str) -> DataFrame:
    """Adds split: test, train or unassigned."""
    known = folds.select(F.col("form_key").alias("_form"), "fold_id")
    split = F.when(F.col("fold_id") == test_fold, "test").when(F.col("fold_id").isNotNull(), "train").otherwise("unassigned")
    return rows.join(known, F.col(form) == F.col("_form"), "left").withColumn("split", split).drop("_form", "fold_id")


def node_texts(mentions: DataFrame, node: str, order: str, n_spans: int = 20, n_contexts: int = 5) -> DataFrame:
    """The text that stands for a node: its first spans and contexts, in order."""
    ranked = mentions.select(node, order, "span", "local_context").withColumn("_r", F.row_number().over(Window.partitionBy(node).orderBy(order))).filter(F.col("_r") <= max(n_spans, n_contexts))
    got = ranked.groupBy(node).agg(F.array_sort(F.collect_list(F.struct("_r", "span", "local_context"))).alias("a"))
    part = lambda n, c: F.transform(F.slice("a", 1, n), lambda x: text.collapsed(x[c]))
    return got.select(node, F.array_join(F.concat(part(n_spans, "span"), part(n_contexts, "local_context")), " || ").alias("node_text"))
