"""Identifier resolution against an inventory: a cascade of look-ups, first that holds wins.

Given (identifier, label) pairs are made distinct first and resolved once each: their keys are
joined with one look-up table, brought back to one row a pair, and one CASE decides. So the cost is
that of the pairs that occur, and the rows themselves meet only the resolved pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text

# Names that are no labels, and decision fields of whole sentences.
RESERVED = ("", "unmatched_language", "unmatched", "no_match", "no match", "none", "null", "unknown", "invalid", "n/a", "na")
DECISION_IDS = (
    "ODRL::Rule_TestSentence", "FHIR_Consent::Consent.provision.type", "FHIR::Consent.provision.type", "FHIR_Consent::Consent.decision", "FHIR::Consent.decision",
    "DUO::DUO.decision", "ICO::ICO.decision",
)
DECISION_LABELS = ("Rule_TestSentence", "Consent.provision.type", "Consent.decision")

_ALL = ("exact", "source", "pair", "normalized", "label", "model_label")


def label_key(x: Column) -> Column:
    return F.lower(text.collapsed(x))


def _aliases(model: Column) -> Column:
    return F.array_distinct(F.array(model, F.replace(model, F.lit("_Consent"), F.lit("")), F.replace(model, F.lit("_"), F.lit(""))))


def lookup(inventory: DataFrame, order: str = "union_element_id") -> DataFrame:
    """kind, key, n (distinct ids with the key), found (the id; of a pair the last in order),
    found_label. Kinds: exact id, source id, alias|source id, normalized spelling, label, model|label."""
    i = inventory.select("union_element_id", "source_model", "source_element_id", "source_element_label", F.col(order).alias("at"))
    uid, model, sid, label = (F.col(c) for c in ("union_element_id", "source_model", "source_element_id", "source_element_label"))
    colon = F.instr(sid, ":")
    prefix, suffix = F.substring_index(sid, ":", 1), F.substring(sid, colon + 1, F.length(sid))
    own = lambda a: (colon > 0) & (a == prefix)
    pairs = F.flatten(F.transform(_aliases(model), lambda a: F.array_compact(F.array(F.concat(a, F.lit("|"), sid), F.when(own(a), F.concat(a, F.lit("|"), suffix))))))
    spelt = F.flatten(F.transform(_aliases(model), lambda a: F.array_compact(F.array(F.concat(a, F.lit("::"), sid), F.when(own(a), F.concat(a, F.lit("::"), suffix))))))
    spellings = F.filter(F.array_distinct(F.transform(F.concat(F.array(uid, sid, label), spelt), text.id_key)), lambda k: k != "")
    named = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    keys = F.concat(
        named("exact", F.array(uid)), named("source", F.array(sid)), named("pair", pairs), named("normalized", spellings),
        named("label", F.array(label_key(label))), named("model_label", F.array(F.concat(F.lower(model), F.lit("|"), label_key(label)))),
    )
    rows = i.select("union_element_id", "at", label_key(label).alias("found_label"), F.inline(keys))
    last = F.max_by(F.struct("union_element_id", "found_label"), F.struct("at", "union_element_id"))
    return rows.groupBy("kind", "key").agg(F.countDistinct("union_element_id").alias("n"), last.alias("last")).select("kind", "key", "n", F.col("last.union_element_id").alias("found"), F.col("last.found_label").alias("found_label"))


def _candidate_keys(uid: Column, label: Column) -> Column:
    """(name, kind, key) of all look-ups of a pair."""
    model, rest = F.substring_index(uid, ":", 1), F.substring(uid, F.instr(uid, ":") + 1, F.length(uid))
    single = ~F.contains(uid, F.lit("::")) & F.contains(uid, F.lit(":"))
    hint = F.when(F.contains(uid, F.lit("::")), F.substring_index(uid, "::", 1)).when(F.contains(uid, F.lit(":")), model).otherwise("")
    one = lambda name, kind, key: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), key.alias("key"))
    bar = lambda a, b: F.concat(a, F.lit("|"), b)
    return F.array(
        one("exact", "exact", uid), one("source", "source", uid),
        one("pair1", "pair", F.when(single, bar(model, rest))), one("pair2", "pair", F.when(single, bar(model, F.concat(model, F.lit(":"), rest)))),
        one("pair3", "pair", F.when(single, bar(F.replace(model, F.lit("FHIR"), F.lit("FHIR_Consent")), rest))),
        one("normalized", "normalized", F.nullif(text.id_key(uid), F.lit(""))),
        one("label", "label", F.when(label != "", label_key(label))), one("model_label", "model_label", F.when((label != "") & (hint != ""), bar(F.lower(hint), label_key(label)))),
    )


def _answers(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs (uid, label) with a struct (n, found, found_label) by look-up name."""
    asked = pairs.select("uid", "label", F.inline(_candidate_keys(F.col("uid"), F.coalesce("label", F.lit("")))))
    met = asked.join(table, ["kind", "key"], "left").filter("n is not null or name = 'exact'")
    got = F.map_from_entries(F.collect_list(F.struct("name", F.struct("n", "found", "found_label"))))
    return met.groupBy("uid", "label").agg(got.alias("got"))


def _chosen(uid: Column, label: Column, got: Column) -> Column:
    """(resolved_id, status, reason) of a pair."""
    at = lambda name: F.try_element_at(got, F.lit(name))
    given = label != ""
    fits = lambda x: x["n"].isNotNull() & (~given | (label_key(label) == x["found_label"]))
    out = lambda found, status, with_label, without=None: F.struct(found.alias("resolved_id"), F.lit(status).alias("status"), (F.when(given, with_label).otherwise(without) if without else F.lit(with_label)).alias("reason"))
    exact, source, normalized = at("exact"), at("source"), at("normalized")
    case = (
        F.when(uid.isNull(), out(uid, "invalid", "not_string")).when(uid == "", out(uid, "invalid", "empty"))
        .when(F.lower(text.collapsed(uid)).isin(*RESERVED), out(uid, "routed_to_unmatched", "reserved_non_label_id"))
        .when(exact["n"].isNotNull() & ~fits(exact), out(uid, "invalid", "label_mismatch_for_exact_union_id"))
        .when(exact["n"].isNotNull(), out(uid, "valid", "exact_union_id_label_match", "exact_union_id_no_label_returned"))
        .when((source["n"] == 1) & fits(source), out(source["found"], "repaired", "exact_source_element_id_label_match", "exact_source_element_id_no_label_returned"))
    )
    for name in ("pair1", "pair2", "pair3"):
        case = case.when(fits(at(name)), out(at(name)["found"], "repaired", "source_model_pair_label_match", "source_model_pair_no_label_returned"))
    return (
        case.when((normalized["n"] == 1) & given & fits(normalized), out(normalized["found"], "repaired", "normalized_id_and_label_match"))
        .when((normalized["n"] == 1) & ~given, out(uid, "invalid", "normalized_id_match_requires_label"))
        .when(normalized["n"] > 1, out(uid, "invalid", "ambiguous_normalized_id_match"))
        .when(at("model_label")["n"] == 1, out(at("model_label")["found"], "repaired", "unique_source_element_label_match"))
        .when(at("label")["n"] == 1, out(at("label")["found"], "repaired", "unique_source_element_label_match"))
        .otherwise(out(uid, "invalid", "no_inventory_match"))
    )


def _simply(uid: Column, got: Column) -> Column:
    """(resolved_id, status): the three states that a validator tells apart, labels left aside."""
    at = lambda name: F.try_element_at(got, F.lit(name))
    out = lambda found, status: F.struct(found.alias("resolved_id"), F.lit(status).alias("status"))
    case = F.when(uid.isNull() | (uid == ""), out(uid, "invalid")).when(at("exact")["n"].isNotNull(), out(uid, "valid")).when(at("source")["n"] == 1, out(at("source")["found"], "repairable"))
    for name in ("pair1", "pair2", "pair3"):
        case = case.when(at(name)["n"].isNotNull(), out(at(name)["found"], "repairable"))
    return case.otherwise(out(uid, "invalid"))


def _with(rows: DataFrame, inventory: DataFrame, given: str, label: Column, choose, order: str) -> DataFrame:
    pair = F.struct(F.trim(given).alias("uid"), text.collapsed(label).alias("label"))
    paired = rows.withColumn("_pair", pair)
    pairs = paired.select("_pair.uid", "_pair.label").distinct()
    known = _answers(pairs, lookup(inventory, order)).select(F.struct("uid", "label").alias("_known"), choose(F.col("uid"), F.col("label"), F.col("got")).alias("_r"))
    return paired.join(known, F.col("_pair").eqNullSafe(F.col("_known")), "left").select(*rows.columns, "_r.*")


def resolve(rows: DataFrame, inventory: DataFrame, given: str = "given_id", label: str = "given_label", order: str = "union_element_id") -> DataFrame:
    """Adds resolved_id, status (valid, repaired, routed_to_unmatched, invalid) and reason."""
    return _with(rows, inventory, given, F.col(label), _chosen, order)


def repairable(rows: DataFrame, inventory: DataFrame, given: str = "given_id", order: str = "union_element_id") -> DataFrame:
    """Adds resolved_id and status (valid, repairable, invalid)."""
    return _with(rows, inventory, given, F.lit(""), lambda u, _, got: _simply(u, got), order)


def by_alias(rows: DataFrame, inventory: DataFrame, model: str, label: str) -> DataFrame:
    """Adds found_id, label_found and status (valid, ambiguous, invalid): within a row's model, known by
    any of its aliases, by source id or label; beyond it by a label that only one element has."""
    i = inventory.select("union_element_id", "source_element_label", F.explode(_aliases(F.col("source_model"))).alias("alias"), "source_element_id")
    near = i.select(F.lower("alias").alias("_m"), F.explode(F.array(F.lower("source_element_id"), label_key(F.col("source_element_label")))).alias("_k"), "union_element_id", "source_element_label")
    near = near.filter("_k <> ''").groupBy("_m", "_k").agg(F.countDistinct("union_element_id").alias("_n"), F.min(F.struct("union_element_id", "source_element_label")).alias("_f"))
    far = inventory.groupBy(label_key(F.col("source_element_label")).alias("_l")).agg(F.countDistinct("union_element_id").alias("_ln"), F.min(F.struct("union_element_id", "source_element_label")).alias("_lf")).filter("_l <> ''")
    keyed = rows.withColumn("_rk", label_key(F.col(label))).withColumn("_rm", F.lower(text.collapsed(F.col(model))))
    met = keyed.join(near, (F.col("_rm") == F.col("_m")) & (F.col("_rk") == F.col("_k")), "left").join(far, F.col("_rk") == F.col("_l"), "left")
    found = F.when(F.col("_n") == 1, F.col("_f")).when(F.col("_n").isNull() & (F.col("_ln") == 1), F.col("_lf"))
    status = F.when(found.isNotNull(), "valid").when((F.col("_n") > 1) | (F.col("_ln") > 1), "ambiguous").otherwise("invalid")
    return met.select(*rows.columns, found["union_element_id"].alias("found_id"), found["source_element_label"].alias("label_found"), status.alias("status"))


def validated(annotations: DataFrame, inventory: DataFrame, keys: list[str], given: str = "given_id", label: str = "given_label", span: str = "span", order: str = "union_element_id") -> DataFrame:
    """One row per keys: counts by status, the valid (or repaired) annotations, those that are
    invalid, and unmatched language: unmatched_language has the spans of routed annotations, each once,
    unmatched_items each span and reason once (case aside), in order."""
    r = resolve(annotations, inventory, given, label, order)
    good, status = F.col("status").isin("valid", "repaired"), F.col("status")
    item = F.struct("ann_idx", F.col(span).alias("span"), F.col("resolved_id").alias("id"), "status", "reason")
    kept = lambda c: F.array_sort(F.collect_list(F.when(c, item)))
    routed = (status == "routed_to_unmatched") & (text.collapsed(F.col(span)) != "")
    out = r.groupBy(*keys).agg(
        F.count("*").alias("n_annotations_raw"), F.count_if(status == "valid").alias("n_valid"), F.count_if(status == "repaired").alias("n_repaired"), F.count_if(status == "invalid").alias("n_invalid"),
        F.count_if(status == "routed_to_unmatched").alias("n_routed"), kept(good).alias("annotations"), kept(status == "invalid").alias("invalid_annotations"),
        F.array_sort(F.collect_list(F.when(routed, F.struct("ann_idx", text.collapsed(F.col(span)).alias("span"), "reason")))).alias("_spans"),
    )
    once = lambda key: F.filter("_spans", lambda s, i: F.array_position(F.transform("_spans", key), key(s)) == i + 1)
    spans = F.transform(once(lambda s: F.lower(s["span"])), lambda s: s["span"])
    items = F.transform(once(lambda s: F.concat_ws("\x01", F.lower(s["span"]), s["reason"])), lambda s: F.struct(s["span"].alias("span"), s["reason"].alias("reason")))
    return out.withColumns({"unmatched_language": spans, "unmatched_items": items}).drop("_spans")


def invalid_audit(annotations: DataFrame, inventory: DataFrame, given: str = "given_id", label: str = "given_label", order: str = "union_element_id") -> DataFrame:
    """The annotations whose identifier is not valid as given, with what it was resolved to."""
    r = resolve(annotations, inventory, given, label, order).filter("status <> 'valid'")
    return r.withColumn("resolved_id", F.when(F.col("status") == "repaired", F.col("resolved_id")).otherwise(""))


def readiness(annotations: DataFrame, quarantined: DataFrame, forward: DataFrame, backward: DataFrame, failures: DataFrame, inventory: DataFrame, threshold: float = 0.05, given: str = "given_id") -> DataFrame:
    """One row: identifiers by state, rates, and the strict and the pragmatic gate of a whole run.
    forward has parse_ok and has_interpretation, backward parse_ok."""
    a = repairable(annotations, inventory, given).agg(F.count("*").alias("n_annotations_total"), F.count_if(F.col("status") == "repairable").alias("n_repairable"), F.count_if(F.col("status") == "invalid").alias("n_invalid_primary"))
    q = quarantined.agg(F.count("*").alias("n_invalid_quarantined"))
    f = forward.agg(F.count("*").alias("n_forward"), F.count_if(~F.col("parse_ok")).alias("n_forward_errors"), F.count_if("has_interpretation").alias("n_interpreted"))
    b = backward.agg(F.count("*").alias("n_backward"), F.count_if(~F.col("parse_ok")).alias("n_backward_errors"))
    x = failures.agg(F.count("*").alias("n_failed"))
    one = a.crossJoin(q).crossJoin(f).crossJoin(b).crossJoin(x)  # of one row each
    c = F.col
    primary = c("n_repairable") + c("n_invalid_primary")
    rate = c("n_invalid_quarantined") / F.greatest(F.lit(1), "n_annotations_total")
    sound = (c("n_forward") > 0) & (c("n_backward") == c("n_forward")) & (c("n_failed") == 0) & (c("n_forward_errors") == 0) & (c("n_backward_errors") == 0) & (c("n_interpreted") == c("n_forward"))
    return one.select(
        "*", (primary + c("n_invalid_quarantined")).alias("n_problem_total"), rate.alias("quarantine_rate"),
        (sound & (primary + c("n_invalid_quarantined") == 0)).alias("ready_strict"), (sound & (primary == 0) & (rate <= threshold)).alias("ready_pragmatic"),
    )


def sentence_level(elements: DataFrame, inventory: DataFrame, value: str = "value", given: str = "given_id", label: str = "given_label", valid_spans: str = "n_valid_spans") -> DataFrame:
    """Adds canonical_value, resolved_id, status and outcome: included, or why an element of a whole
    sentence is left out."""
    r = resolve(elements, inventory, given, label).withColumn("canonical_value", text.decision(F.col(value)))
    names = inventory.select(F.col("union_element_id").alias("_u"), F.col("source_element_label").alias("_name"))
    r = r.join(names, F.col("resolved_id") == F.col("_u"), "left")
    approved = F.col("resolved_id").isin(*DECISION_IDS) | F.coalesce(F.col("_name").isin(*DECISION_LABELS), F.lit(False))
    outcome = (
        F.when(F.col(valid_spans) < 1, "no_valid_span_annotations").when(text.collapsed(F.col(given)) == "", "missing_union_element_id")
        .when(F.col("canonical_value") == "", "non_controlled_or_explanatory_value").when(~F.col("status").isin("valid", "repaired"), F.concat(F.lit("invalid_sentence_level_id:"), "reason"))
        .when(~approved, "not_approved_sentence_decision_field").otherwise("included")
    )
    return r.withColumn("outcome", outcome).drop("_u", "_name")


def fill_blank(rows: DataFrame, table: DataFrame, keys: list[Column], table_key: str, columns: list[str], order: str) -> DataFrame:
    """Blank columns of rows are filled from table by the first key that is known; of several
    table rows with a key the first in order counts."""
    first = table.groupBy(table_key).agg(F.min_by(F.struct(*columns), F.struct(order)).alias("_first"))
    out = rows
    for i, key in enumerate(keys):
        out = out.withColumn(f"_key{i}", key).join(first.select(F.col(table_key).alias(f"_t{i}"), F.col("_first").alias(f"_f{i}")), F.col(f"_key{i}") == F.col(f"_t{i}"), "left")
    filled = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), *(F.col(f"_f{i}")[c] for i in range(len(keys)))) for c in columns}
    return out.withColumns(filled).select(*rows.columns)


def fold_matches(forms: DataFrame, folds: DataFrame, form: str = "form", key: str = "form_key", fold: str = "fold_id") -> DataFrame:
    """forms with fold_id and match_type: exact, unique_loose (punctuation and case aside),
    ambiguous_loose or unmatched."""
    exact = folds.select(F.col(key).alias("_k"), F.col(fold).alias("_exact")).distinct()
    loose = folds.groupBy(text.loose_key(F.col(key)).alias("_l")).agg(F.countDistinct(key).alias("_n"), F.min(fold).alias("_loose"))
    met = forms.join(exact, F.col(form) == F.col("_k"), "left").withColumn("_fl", text.loose_key(F.col(form))).join(loose, F.col("_fl") == F.col("_l"), "left")
    kind = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_n") == 1, "unique_loose").when(F.col("_n") > 1, "ambiguous_loose").otherwise("unmatched")
    return met.select(*forms.columns, F.when(kind == "exact", F.col("_exact")).when(kind == "unique_loose", F.col("_loose")).alias("fold_id"), kind.alias("match_type"))


def fold_aliases(forms: DataFrame, folds: DataFrame, form: str = "form", key: str = "form_key", fold: str = "fold_id") -> DataFrame:
    """folds with a row more for each form that is known by another spelling only."""
    new = fold_matches(forms.select(form).distinct(), folds, form, key, fold).filter("match_type = 'unique_loose'").select(F.col(form).alias(key), F.col("fold_id").alias(fold))
    return folds.select(key, fold).unionByName(new)
