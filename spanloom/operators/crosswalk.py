"""Crosswalks from source elements to functional fields: rules, alignments, fallbacks, schema checks."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators.mentions import first_filled

# Fixed value: what the texts of an element say if it holds a decision on a whole sentence.
DECISION = r"(provision\.type|consent\.decision|rule_testsentence|duo\.decision|ico\.decision|decision$)"


class Rule(NamedTuple):
    """An element of this model (any, if empty) that has one of these names, or one of these words in its
    name or in all that is said of it, maps to a field, with a mapping type, a note and further fields."""

    model: str
    field: str
    kind: str
    note: str
    also: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    in_name: tuple[str, ...] = ()
    in_text: tuple[str, ...] = ()


_ACT = "near_equivalent_or_action_subtype"
_FHIR = "FHIR {} maps to the corresponding functional V1 role"
_ODRL_PARTY = "ODRL Party may denote participant, actor, institution, or repository depending on span"
_ODRL_CONSTRAINT = "ODRL Constraint may denote temporal, purpose, privacy, exception, or restriction scope"
_WORDS = "keyword fallback based on source label/definition; review required"
# Words and names of elements, and the fields, mapping types, notes and further fields that they
# stand for, in the order in which they count.
RULES = (
    Rule("odrl", "participant_or_subject", "context_dependent_split", _ODRL_PARTY, ("authorized_actor", "institution_or_custodian", "repository_or_registry"), in_name=("party",)),
    Rule("odrl", "governed_resource", "near_equivalent", "ODRL Asset denotes the governed data/specimen/object", in_name=("asset",)),
    Rule("odrl", "governed_action", _ACT, "ODRL Action denotes the governed act", ("choice_or_withdrawal_right", "contact_or_request"), in_name=("action",)),
    Rule("odrl", "condition_or_exception", "context_dependent_split", _ODRL_CONSTRAINT, ("temporal_scope", "purpose_or_use_context", "restriction_or_prohibition", "privacy_or_identifiability"), in_name=("constraint",)),
    Rule("odrl", "sentence_decision", "exact_decision_plus_cue", "ODRL Permission encodes permit polarity; textual cues map separately", ("decision_cue_or_consent_act",), in_name=("permission",)),
    Rule("odrl", "sentence_decision", "exact_decision_plus_restriction", "ODRL Prohibition encodes deny polarity and often supports restrictions", ("restriction_or_prohibition",), in_name=("prohibition",)),
    Rule("odrl", "sentence_decision", "exact_obligation_plus_action", "ODRL Duty encodes obligation-like provision polarity", ("governed_action", "consequence_or_protection"), in_name=("duty", "obligation")),
    Rule("fhir", "participant_or_subject", "near_equivalent", _FHIR, names=("consent.subject",)),
    Rule("fhir", "participant_or_subject", "near_equivalent_or_consent_actor", _FHIR, ("decision_cue_or_consent_act",), names=("consent.grantor",)),
    Rule("fhir", "authorized_actor", "context_dependent_split", _FHIR, ("institution_or_custodian",), names=("consent.grantee",)),
    Rule("fhir", "institution_or_custodian", "context_dependent_split", _FHIR, ("authorized_actor", "repository_or_registry"), names=("consent.controller",)),
    Rule("fhir", "institution_or_custodian", "context_dependent_split", _FHIR, ("authorized_actor",), names=("consent.manager",)),
    Rule("fhir", "authorized_actor", "context_dependent_split", _FHIR, ("institution_or_custodian",), names=("consent.provision.actor",)),
    Rule("fhir", "authorized_actor", "context_dependent_split", _FHIR, ("participant_or_subject",), names=("consent.provision.actor.role",)),
    Rule("fhir", "governed_resource", "near_equivalent", _FHIR, ("privacy_or_identifiability",), names=("consent.provision.data",)),
    Rule("fhir", "governed_action", _ACT, _FHIR, ("choice_or_withdrawal_right", "contact_or_request"), names=("consent.provision.action",)),
    Rule("fhir", "governed_action", _ACT, _FHIR, ("choice_or_withdrawal_right",), names=("consent.action",)),
    Rule("fhir", "purpose_or_use_context", "near_equivalent", _FHIR, ("research_domain_or_study_topic",), names=("consent.provision.purpose",)),
    Rule("fhir", "temporal_scope", "near_equivalent", _FHIR, ("temporal_target",), names=("consent.provision.period",)),
    Rule("fhir", "temporal_scope", "near_equivalent", _FHIR, ("temporal_target",), names=("consent.period",)),
    Rule("fhir", "temporal_scope", "near_equivalent", _FHIR, ("temporal_target", "study_or_data_lifecycle"), names=("consent.provision.dataperiod",)),
    Rule("fhir", "privacy_or_identifiability", "near_equivalent", _FHIR, ("restriction_or_prohibition",), names=("consent.provision.securitylabel",)),
    Rule("fhir", "purpose_or_use_context", "partial", _FHIR, ("study_or_data_lifecycle",), names=("consent.category",)),
    Rule("fhir", "residual_important_content", "container_no_direct_mapping", _FHIR, names=("consent.provision",)),
    Rule("fhir", "residual_important_content", "container_no_direct_mapping", _FHIR, names=("consent",)),
    Rule("duo", "purpose_or_use_context", "near_equivalent_or_partial", "DUO data-use purpose/research-use category", ("research_domain_or_study_topic", "condition_or_exception"), names=("gru", "hmb", "ps"), in_text=("general research", "health")),
    Rule("duo", "research_domain_or_study_topic", "partial", "DUO category constrains research topic/domain or allowed use scope", ("purpose_or_use_context", "restriction_or_prohibition"), names=("ds", "gso", "rs", "gs", "nres"), in_text=("disease", "population")),
    Rule("duo", "temporal_scope", "partial", "DUO temporal/retention category", ("temporal_target", "study_or_data_lifecycle"), names=("ts", "rtn"), in_text=("time", "retention")),
    Rule("duo", "restriction_or_prohibition", "partial", "DUO restriction or governance condition", ("condition_or_exception", "privacy_or_identifiability"), names=("col", "nmds", "pub", "irb"), in_text=("restriction",)),
    Rule("ico", "choice_or_withdrawal_right", "near_equivalent", "ICO participation/withdrawal/choice element", ("decision_cue_or_consent_act", "governed_action"), in_text=("withdraw", "refus", "declin", "choice", "voluntar")),
    Rule("ico", "decision_cue_or_consent_act", "near_equivalent", "ICO consent/authorization act or cue", ("sentence_decision",), in_text=("consent", "permission", "authorize", "agree", "informed consenting")),
    Rule("ico", "participant_or_subject", "near_equivalent", "ICO person role maps to participant/subject", in_text=("participant", "patient", "subject", "consenter")),
    Rule("ico", "authorized_actor", "near_equivalent", "ICO actor role maps to authorized actor", in_text=("researcher", "investigator", "doctor", "physician")),
    Rule("ico", "governed_resource", "near_equivalent", "ICO data/specimen/information element", ("privacy_or_identifiability",), in_text=("specimen", "sample", "biospecimen", "data", "information", "record")),
    Rule("ico", "governed_action", _ACT, "ICO act element maps to governed action", in_text=("use", "collect", "share", "disclos", "access", "return", "destroy", "store")),
    Rule("", "participant_or_subject", "needs_expert_review", _WORDS, ("authorized_actor",), in_text=("participant", "subject", "child", "patient", "consenter", "grantor")),
    Rule("", "authorized_actor", "needs_expert_review", _WORDS, ("institution_or_custodian",), in_text=("researcher", "investigator", "doctor", "physician", "staff", "team", "grantee")),
    Rule("", "institution_or_custodian", "needs_expert_review", _WORDS, ("repository_or_registry",), in_text=("institution", "clinic", "hospital", "university", "custodian", "controller", "manager")),
    Rule("", "repository_or_registry", "needs_expert_review", _WORDS, ("institution_or_custodian",), in_text=("database", "registry", "repository", "biobank", "bank")),
    Rule("", "governed_resource", "needs_expert_review", _WORDS, ("privacy_or_identifiability",), in_text=("data", "sample", "specimen", "dna", "blood", "urine", "saliva", "record", "information", "result")),
    Rule("", "governed_action", "needs_expert_review", _WORDS, in_text=("use", "collect", "store", "share", "disclose", "access", "destroy", "return", "donate", "contact")),
    Rule("", "purpose_or_use_context", "needs_expert_review", _WORDS, ("research_domain_or_study_topic",), in_text=("purpose", "research", "clinical", "public health")),
    Rule("", "temporal_scope", "needs_expert_review", _WORDS, ("temporal_target",), in_text=("period", "duration", "expire", "expiration", "until", "time", "future", "indefinite")),
    Rule("", "condition_or_exception", "needs_expert_review", _WORDS, ("restriction_or_prohibition",), in_text=("condition", "exception", "unless", "except", "only if")),
    Rule("", "restriction_or_prohibition", "needs_expert_review", _WORDS, ("condition_or_exception",), in_text=("prohibit", "restriction", "deny", "not", "cannot")),
    Rule("", "privacy_or_identifiability", "needs_expert_review", _WORDS, in_text=("privacy", "confidential", "identifiable", "de-identified", "anonymous", "security")),
    Rule("", "consequence_or_protection", "needs_expert_review", _WORDS, in_text=("care", "penalty", "benefit", "affect", "protection")),
)
DECISIVE = Rule("", "sentence_decision", "exact_decision", "source element encodes provision-level permit/deny/obligation polarity")
NOTHING = Rule("", "residual_important_content", "no_direct_mapping", "no clear V1 functional mapping from available source metadata")
NOT_IN_SCHEMA = "mapping target not present in schema; routed to residual for review"
REVIEW = ("context_dependent_split", "partial", "no_direct_mapping", "needs_expert_review")
# Columns that may name an element, its model, its label and its definition, the first filled one counts.
ID_COLUMNS = ("union_element_id", "source_element_id", "element_id", "id")
MODEL_COLUMNS = ("information_model", "source_model", "model", "canonical_information_model")
LABEL_COLUMNS = ("source_element_label", "label", "name")
DEFINITION_COLUMNS = ("source_element_definition", "definition", "description")
# Columns that every field of a schema fills.
REQUIRED = ("field_id", "field_name", "definition", "include", "exclude", "assigned_evidence_cards", "source_support")


def _any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(x, F.lit(w)) for w in words))


def _holds(rule: Rule, uid: Column, model: Column, name: Column, words: Column) -> Column:
    met = [name.isin(*rule.names)] if rule.names else []
    met += [_any(name, rule.in_name)] if rule.in_name else []
    met += [_any(words, rule.in_text)] if rule.in_text else []
    of_model = {"": F.lit(True), "fhir": model.startswith("fhir") | F.contains(name, F.lit("consent.")), "ico": (model == "ico") | uid.startswith("ico")}
    return of_model.get(rule.model, model == rule.model) & reduce(or_, met)


def build(inventory: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The inventory with information_model (else the part of the id before ::, else unknown), v1_field,
    mapping_type, secondary_fields, mapping_direction, rationale and whether the mapping needs review.

    The first rule that holds counts. With fields, the names of a schema, a field that it lacks becomes the
    residual one, for review, and further fields that it lacks go. Elements without an id go; nulls are empty;
    columns of these names are replaced."""
    filled = lambda names: first_filled(*(F.col(c) for c in names if c in inventory.columns))
    made = ("information_model", "v1_field", "mapping_type", "secondary_fields", "mapping_direction", "rationale", "requires_context_review")
    uid, said = F.col("_e.uid"), F.col("_e")
    own = F.when(F.contains(uid, F.lit("::")), F.substring_index(uid, "::", 1)).otherwise("unknown")
    known = inventory.withColumn("_e", F.struct(filled(ID_COLUMNS).alias("uid"), filled(MODEL_COLUMNS).alias("model"), F.lower(filled(LABEL_COLUMNS)).alias("label"), F.lower(filled(DEFINITION_COLUMNS)).alias("definition"))).filter(uid != "")
    known = known.withColumn("_m", F.when(said["model"] != "", said["model"]).otherwise(own))
    known = known.withColumn("_w", F.concat_ws(" ", F.lower(uid), F.lower(text.after_first(uid)), said["label"], said["definition"]))
    n = F.when(F.col("_w").rlike(DECISION), 1)
    name = F.lower(text.after_first(uid))
    for i, r in enumerate(RULES, 2):
        n = n.when(_holds(r, F.lower(uid), F.lower("_m"), name, F.col("_w")), i)
    all_rules = json.dumps([r._asdict() for r in (DECISIVE, *RULES, NOTHING)])  # one literal, folded by the optimizer
    rules = F.from_json(F.lit(all_rules), "array<struct<field:string,kind:string,note:string,also:array<string>>>")
    known = known.withColumn("_r", F.element_at(rules, n.otherwise(len(RULES) + 2)))
    field, kind, also = (F.col(f"_r.{c}") for c in ("field", "kind", "also"))
    note = F.replace("_r.note", F.lit("{}"), text.after_first(uid))
    if fields is not None:
        there = field.isin(*fields, "sentence_decision")
        field, kind, note = F.when(there, field).otherwise(NOTHING.field), F.when(there, kind).otherwise("needs_expert_review"), F.when(there, note).otherwise(NOT_IN_SCHEMA)
        also = F.filter(also, lambda x: x.isin(*fields, "sentence_decision"))
    kept = [c for c in inventory.columns if c not in (*made, "union_element_id")]
    columns = (F.col("_m"), field, kind, also, F.lit("source_to_v1"), note, kind.isin(*REVIEW))
    return known.select(uid.alias("union_element_id"), *kept, *(c.alias(n) for n, c in zip(made, columns, strict=True)))


def rule_sql(uid: str, model: str, label: str, definition: str) -> str:
    """All rules in SQL, over expressions without nulls: 'field|type|further fields|note'."""
    name = f"lower(CASE WHEN contains({uid}, '::') THEN substr({uid}, strpos({uid}, '::') + 2) ELSE {uid} END)"
    words = f"(lower({uid}) || ' ' || {name} || ' ' || lower({label}) || ' ' || lower({definition}))"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    of_model = {"": "true", "fhir": f"(lower({model}) LIKE 'fhir%' OR contains({name}, 'consent.'))", "ico": f"(lower({model}) = 'ico' OR lower({uid}) LIKE 'ico%')"}

    def out(r):
        return f"{quoted(f'{r.field}|{r.kind}|' + ';'.join(r.also) + '|')} || replace({quoted(r.note)}, '{{}}', CASE WHEN contains({uid}, '::') THEN substr({uid}, strpos({uid}, '::') + 2) ELSE {uid} END)"

    cases = [f"WHEN regexp_matches({words}, '{DECISION}') THEN {out(DECISIVE)}"]
    for r in RULES:
        met = [f"{name} = {quoted(n)}" for n in r.names] + [f"contains({name}, {quoted(w)})" for w in r.in_name] + [f"contains({words}, {quoted(w)})" for w in r.in_text]
        cases.append(f"WHEN {of_model.get(r.model, f'lower({model}) = {quoted(r.model)}')} AND ({' OR '.join(met)}) THEN {out(r)}")
    return f"CASE {' '.join(cases)} ELSE {out(NOTHING)} END"


def edges(crosswalk: DataFrame) -> DataFrame:
    """One edge an element: from its model and id to its field."""
    return crosswalk.select(F.col("information_model").alias("source_model"), F.col("union_element_id").alias("source_element"), F.col("v1_field").alias("target_v1_field"), "mapping_type", "requires_context_review")


def summary(crosswalk: DataFrame) -> DataFrame:
    return crosswalk.groupBy("information_model", "v1_field", "mapping_type").agg(F.count("*").alias("n_source_elements"))


def matrix(crosswalk: DataFrame, models: list[str]) -> DataFrame:
    """v1_field, and a column a model with its elements of that field; fields that none of them has stay, at 0."""
    return crosswalk.groupBy("v1_field").agg(*(F.count_if(F.col("information_model") == m).alias(m) for m in models))


def alignment(manual: DataFrame, induced: DataFrame, keys: list[str], manual_field: str, induced_field: str, fold: str) -> DataFrame:
    """Pairs of a manual and an induced field (either may be missing) with the elements, models and folds that they share."""
    joined = manual.dropna().distinct().join(induced.dropna().distinct(), keys, "full_outer")
    return joined.groupBy(manual_field, induced_field).agg(F.countDistinct(keys[1]).alias("n_source_elements"), F.countDistinct(keys[0]).alias("n_source_models"), F.array_join(F.array_sort(F.collect_set(fold)), "; ").alias("folds"))


def combined(manual: DataFrame, induced: DataFrame, keys: list[str]) -> DataFrame:
    """One row per element: all that each crosswalk says of it, joined."""
    side = lambda df: df.groupBy(*keys).agg(*(F.array_join(F.array_sort(F.collect_set(F.nullif(text.collapsed(F.col(c)), F.lit("")))), "; ").alias(c) for c in df.columns if c not in keys))
    return side(manual).join(side(induced), keys, "full_outer")


def dictionary(frames: list[DataFrame], key: str) -> DataFrame:
    """The union of several source tables, of each key the row with most text."""
    from spanloom.operators.relational import union_all

    every = union_all(*frames)
    size = sum((F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in every.columns), F.lit(0))
    return every.groupBy(key).agg(F.max_by(F.struct(*(c for c in every.columns if c != key)), F.struct(size, F.to_json(F.struct("*")))).alias("_b")).select(key, "_b.*")


def fallback(fields: DataFrame, field: str, words: str, cards: DataFrame, card: str, terms: str, least: int, n: int) -> DataFrame:
    """field, card, score: the n cards with most terms in a field's text, of at least so many. A card and
    a field meet only on a term that they share."""
    f = fields.select(field, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(words), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("_w"))
    c = cards.select(card, F.explode(F.array_distinct(F.filter(F.transform(terms, F.lower), lambda t: F.length(t) > 3))).alias("_w"))
    met = f.join(c, "_w").groupBy(field, card).agg(F.countDistinct("_w").alias("score")).filter(F.col("score") >= least)
    return met.withColumn("_r", F.row_number().over(Window.partitionBy(field).orderBy(F.desc("score"), card))).filter(F.col("_r") <= n).drop("_r")


def schema_report(rows: DataFrame, cards: DataFrame, decisions: Column, allowed=("deny", "mixed", "permit", "unclear")) -> DataFrame:
    """One row on an induced schema (rows with the REQUIRED columns, cards with seed_cluster_id):
    duplicate ids and names, names that are not snake case, missing content, cards left out."""
    ids, names = F.col("field_id"), F.col("field_name")
    again = lambda c: rows.groupBy(c).agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (c != "")).agg(F.array_sort(F.collect_list(c)).alias("x"))
    missing = sum((F.when(F.col(c).isNull() | (F.col(c).cast("string").isin("", "[]")), 1).otherwise(0) for c in REQUIRED), F.lit(0))
    one = rows.agg(F.count("*").alias("n_fields"), F.count_if(~names.rlike("^[a-z][a-z0-9_]*$")).alias("n_bad_names"), F.coalesce(F.sum(missing), F.lit(0)).alias("n_missing"))
    used = rows.select(F.explode("assigned_evidence_cards").alias("c")).distinct()
    known = cards.select(F.col("seed_cluster_id").alias("c")).distinct()
    covered = known.join(used, "c", "left_semi").agg(F.count("*").alias("n_covered"))
    total = known.agg(F.count("*").alias("n_cards"))
    out = one.crossJoin(again(ids).withColumnRenamed("x", "duplicate_ids")).crossJoin(again(names).withColumnRenamed("x", "duplicate_names")).crossJoin(covered).crossJoin(total)  # of one row each
    fine = F.array_sort(F.array_distinct(decisions)) == F.array(*map(F.lit, sorted(allowed)))
    return out.withColumn("decisions_valid", fine).withColumn("passes", (F.size("duplicate_ids") == 0) & (F.size("duplicate_names") == 0) & (F.col("n_bad_names") == 0) & (F.col("n_missing") == 0) & (F.col("n_fields") > 0) & fine)


def source_elements(cards: DataFrame, card: str, body: str) -> DataFrame:
    """card, source_model, source_element_id, source_element_label of the elements that a card's JSON
    lists, under the first of its known keys that holds any."""
    from spanloom.functions import jsonish

    v = jsonish.parse(F.col(body))
    lists = [jsonish.items(v, f"$.{k}") for k in ("nodes", "source_elements", "members", "sense_nodes")]
    found = lists[-1]
    for x in reversed(lists[:-1]):
        found = F.when(F.size(x) > 0, x).otherwise(found)
    pick = lambda a, *names: jsonish.text_at(a, *(f"$.{n}" for n in names))
    each = F.transform(found, lambda a: F.struct(
        pick(a, "source_model", "information_model").alias("source_model"), pick(a, "source_element_id", "union_element_id", "element_id", "id").alias("source_element_id"),
        pick(a, "source_element_label", "label", "name").alias("source_element_label")))
    return cards.select(card, F.inline(each)).distinct()


# Keys of a card under which its source elements stand, as a list or by model.
ELEMENT_LISTS = ("source_elements", "source_model_elements", "elements", "member_elements", "crosswalk_mappings")
ELEMENTS_BY_MODEL = ("source_model_counts", "source_model_support", "source_elements_by_model")
# What stands for an element that a field's text only names the model of, and how rows came about.
MENTIONED = "mentioned_in_field_definition"
FROM_CARDS, FROM_TEXT, FROM_NOTHING = "evidence_card_source_elements", "field_text_heuristic", "field_without_parseable_source_elements"
_ELEMENT = "struct<source_model:string,source_element:string,source_label:string>"


def supported(body: Column) -> Column:
    """The distinct source elements (source_model, source_element, source_label) of a card's JSON: from its
    lists, whose items are objects or texts (model::element), then from its objects by model, whose values are
    lists, lists in texts, or one value. What has no element goes; no JSON or null gives an empty list."""
    from spanloom.functions import jsonish

    v = jsonish.parse(body)
    at = lambda a, names: text.collapsed(jsonish.text_at(a, *(f"$.{n}" for n in names)))
    is_object = lambda a: F.schema_of_variant(a).startswith("OBJECT")
    plain = lambda a: text.collapsed(F.try_variant_get(a, "$", "string"))
    row = lambda m, e, l: F.struct(m.alias("source_model"), e.alias("source_element"), l.alias("source_label"))  # noqa: E731, E741

    def listed(a):
        s = plain(a)
        own = row(at(a, ("source_model", "information_model", "model")), at(a, ("source_element", "source_element_id", "element_id", "id", "label")), at(a, ("source_label", "label", "name", "element")))
        split = row(F.substring_index(s, "::", 1), text.after_first(s), text.after_first(s))
        return F.when(is_object(a), own).when(F.contains(s, F.lit("::")), split).otherwise(row(F.lit(""), s, s))

    def of_model(model, x):
        s = F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))
        inner = F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.try_variant_get(F.try_parse_json(s), "$", "array<variant>"))
        named = lambda a: F.coalesce(F.nullif(at(a, ("source_model",)), F.lit("")), model)
        one = lambda a: F.when(is_object(a), row(named(a), at(a, ("source_element", "element_id", "label")), at(a, ("source_label", "label")))).otherwise(row(model, plain(a), plain(a)))
        parts = F.transform(F.split(s, "[;|,]"), text.collapsed)
        whole = F.when(is_object(x), F.array(one(x))).otherwise(F.transform(parts, lambda p: row(model, p, p)))
        return F.when(inner.isNotNull(), F.transform(inner, one)).otherwise(whole)

    empty = F.array().cast(f"array<{_ELEMENT}>")
    found = [F.transform(jsonish.items(v, f"$.{k}"), listed) for k in ELEMENT_LISTS]
    for k in ELEMENTS_BY_MODEL:
        entries = F.map_entries(F.try_variant_get(v, f"$.{k}", "map<string,variant>"))
        found.append(F.coalesce(F.flatten(F.transform(entries, lambda e: of_model(text.collapsed(e["key"]), e["value"]))), empty))
    return F.array_distinct(F.filter(F.concat(*found), lambda r: r["source_element"] != ""))


def from_schemas(fields: DataFrame, cards: DataFrame, manual: DataFrame) -> DataFrame:
    """The crosswalk of induced schemas: a row for each field of a fold and each source element that its
    evidence cards list, with the manual fields of that element.

    fields: fold, field_id, field_name, definition, tier, evidence_ids (array), said (text in which source
    models may be named). cards: fold, card, body. manual: source_model, source_element, manual_field.
    An evidence id finds the card of that id in its own fold and, as an id alone, that in the least fold which
    has one; of several bodies of one card the greatest counts. A field without elements gets those models that
    its text names, else one row without a model. Nulls are empty; repeated rows count once."""
    from spanloom.operators.schema import models_named

    ids = F.filter(F.coalesce("evidence_ids", F.array().cast("array<string>")), lambda x: x.isNotNull())
    plain = ["fold", "field_id", "field_name", "definition", "tier"]
    f = fields.select(*(text.collapsed(F.col(c)).alias(c) for c in plain), ids.alias("_ids"), text.blank(F.col("said")).alias("_said")).distinct()
    f = f.withColumn("evidence_card_ids", F.array_join("_ids", "; "))
    key = [*plain, "evidence_card_ids"]
    c = cards.groupBy("fold", "card").agg(F.max("body").alias("_b")).select("fold", "card", supported(F.col("_b")).alias("_e"))
    by_fold = c.select(F.concat_ws("::", "fold", "card").alias("_k"), "_e")
    alone = c.groupBy("card").agg(F.min_by("_e", F.coalesce("fold", F.lit(""))).alias("_e")).select(F.col("card").alias("_k"), "_e")
    asked = f.select(*key, F.explode("_ids").alias("_id")).select(*key, F.explode(F.array(F.concat_ws("::", "fold", "_id"), "_id")).alias("_k"))
    parsed = asked.join(by_fold.unionByName(alone), "_k").select(*key, F.inline("_e")).distinct()
    named = F.transform(models_named(F.col("_said")), lambda m: F.struct(m.alias("source_model"), F.lit(MENTIONED).alias("source_element"), F.lit(MENTIONED).alias("source_label")))
    none = F.array(F.struct(*(F.lit("").alias(n) for n in ("source_model", "source_element", "source_label"))))
    rest = f.join(parsed.select(key).distinct(), key, "left_anti").select(*key, F.inline(F.when(F.size(named) > 0, named).otherwise(none))).distinct()
    basis = F.when(F.col("source_element") == "", FROM_NOTHING).when(F.col("evidence_card_ids") != "", FROM_CARDS).otherwise(FROM_TEXT)
    ends = [F.lower(text.collapsed(F.col(x))).alias(y) for x, y in (("source_model", "_m"), ("source_element", "_s"))]
    known = manual.select(*ends, text.collapsed(F.col("manual_field")).alias("_f")).filter("_s <> ''").groupBy("_m", "_s").agg(F.array_join(F.array_sort(F.collect_set("_f")), "; ").alias("_l"))
    out = parsed.unionByName(rest).withColumn("mapping_basis", basis).withColumns({"_m": F.lower("source_model"), "_s": F.lower("source_element")})
    return out.join(known, ["_m", "_s"], "left").withColumn("manual_fields", F.coalesce("_l", F.lit(""))).drop("_m", "_s", "_l")
