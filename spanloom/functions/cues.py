"""Cue-dictionary columns: which terms of which groups a text has, and what a reconstruction lost."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import sets

# Patterns of cue groups.
PATTERNS = {
    "permission": [r"\bcan\b", r"\bmay\b", r"\bare allowed\b", r"\bis allowed\b", r"\bpermission\b", r"\bpermit(?:ted)?\b", r"\bauthori[sz]e(?:d)?\b", r"\bchoose\b", r"\bchoice\b", r"\bdecide\b", r"\boptional\b"],
    "obligation": [r"\bmust\b", r"\brequired\b", r"\brequirement\b", r"\bneed to\b", r"\bneeds to\b", r"\bhave to\b", r"\bhas to\b", r"\bwill need\b", r"\bwill be asked\b", r"\bwe ask\b", r"\bwe are asking\b"],
    "prohibition": [r"\bcannot\b", r"\bcan't\b", r"\bmay not\b", r"\bmust not\b", r"\bnot allowed\b", r"\bnever\b", r"\bno\b", r"\bprohibit(?:ed|ion)?\b", r"\bwithout\b"],
    "condition": [r"\bif\b", r"\bwhen\b", r"\bunless\b", r"\bonly if\b", r"\bas long as\b", r"\bin order to\b", r"\bdepending on\b"],
    "constraint_or_exception": [r"\bonly\b", r"\bexcept\b", r"\bexception\b", r"\blimit(?:ed|ation|s)?\b", r"\brestrict(?:ed|ion|s)?\b", r"\bconstraint\b", r"\bsubject to\b"],
    "time_or_duration": [r"\bat any time\b", r"\bany time\b", r"\bfuture\b", r"\blater\b", r"\bbefore\b", r"\bafter\b", r"\buntil\b", r"\bduring\b", r"\bfor at least\b", r"\byear(?:s)?\b", r"\bmonth(?:s)?\b", r"\bday(?:s)?\b", r"\bongoing\b", r"\blong-term\b"],
    "withdrawal": [r"\bwithdraw(?:al|n)?\b", r"\bquit\b", r"\bstop taking part\b", r"\bstop participating\b", r"\bleave the study\b", r"\bdrop out\b"],
    "consent_or_choice": [r"\bconsent\b", r"\bagree\b", r"\bagreement\b", r"\byes\b", r"\bno\b", r"\bjoin\b", r"\bparticipate\b", r"\btake part\b", r"\bdecide\b"],
    "data_or_specimen": [r"\bdata\b", r"\binformation\b", r"\brecords?\b", r"\bmedical records?\b", r"\bhealth records?\b", r"\bsamples?\b", r"\bspecimens?\b", r"\btissue\b", r"\bblood\b", r"\bbiospecimen\b", r"\bdna\b", r"\bgenetic\b", r"\bgenomic\b"],
    "use_or_analysis": [r"\buse\b", r"\bused\b", r"\busing\b", r"\banaly[sz]e\b", r"\banaly[sz]ed\b", r"\btest\b", r"\btesting\b", r"\bstudy\b", r"\bresearch\b"],
    "sharing_or_access": [r"\bshare\b", r"\bshared\b", r"\bsharing\b", r"\bdisclose\b", r"\bdisclosure\b", r"\brelease\b", r"\bgive\b", r"\bsend\b", r"\baccess\b", r"\bavailable to\b", r"\bprovide\b"],
    "privacy_or_identifiability": [r"\bprivate\b", r"\bprivacy\b", r"\bconfidential\b", r"\bidentify\b", r"\bidentified\b", r"\bidentifiable\b", r"\bde-?identified\b", r"\bcoded\b", r"\banonymous\b", r"\bname\b", r"\bcontact information\b"],
    "actor_or_recipient": [r"\byou\b", r"\bwe\b", r"\bresearchers?\b", r"\bscientists?\b", r"\binvestigators?\b", r"\bdoctor(?:s)?\b", r"\bstudy team\b", r"\ball of us\b", r"\bcompany\b", r"\bthird part(?:y|ies)\b"],
    "risk_or_benefit": [r"\brisk(?:s)?\b", r"\bbenefit(?:s)?\b", r"\bharm\b", r"\bincidental\b", r"\bresults?\b", r"\breturn(?:ed)?\b", r"\bfindings?\b"],
}
# Groups whose loss is critical, and the error flags with the groups they look at.
CRITICAL = (
    "permission", "obligation", "prohibition", "condition", "constraint_or_exception", "time_or_duration", "withdrawal", "sharing_or_access", "privacy_or_identifiability",
    "data_or_specimen",
)
DROPPED = {
    "prohibition_cue_dropped": ["prohibition"], "negation_cue_dropped": ["negation"], "condition_scope_or_exception_cue_dropped": ["condition", "restriction", "exception"],
    "withdrawal_choice_cue_dropped": ["withdrawal"],
}
CHANGED = {
    "governed_action_changed": "action", "governed_resource_changed": "resource", "actor_or_recipient_changed": "actor", "purpose_or_use_context_changed": "purpose",
    "temporal_expression_changed": "temporal", "privacy_identifiability_changed": "privacy_identifiability",
}


def load(path: str) -> dict[str, list[str]]:
    """The groups of an external dictionary."""
    with open(path) as f:
        return {g: list(t) for g, t in json.load(f)["cue_groups"].items()}


def merged(base: dict[str, list[str]], override: dict[str, list[str]]) -> dict[str, list[str]]:
    """Groups of override replace those of base; groups only in base stay."""
    return {**base, **override}


def pattern(term: str) -> str:
    """A term with a blank or sign is found anywhere, others as words."""
    return re.escape(term) if re.search(r"[^a-zA-Z0-9]", term) else rf"\b{term}\b"


def found(text: Column, terms: list[str]) -> Column:
    """The terms that occur, in the dictionary's order. Words are looked up in the set of the text's
    words in one pass; only terms with a blank or sign are searched for one by one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = [t for t in terms if not re.search(r"[^a-zA-Z0-9]", t)]
    if not plain:
        return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), t) for t in terms)))
    words = F.regexp_extract_all(low, F.lit(r"\b(" + "|".join(sorted(plain, key=len, reverse=True)) + r")\b"), F.lit(1))
    if len(plain) == len(terms):
        return F.array_intersect(F.array(*map(F.lit, terms)), words)
    met = F.array_union(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), t) for t in terms if t not in plain))), words)
    return F.array_intersect(F.array(*map(F.lit, terms)), met)


def groups_in(text: Column, cues: dict[str, list[str]]) -> Column:
    """Groups with a term anywhere in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    anywhere = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))
    return F.array_compact(F.array(*(F.when(anywhere(t), g) for g, t in cues.items())))


def pattern_groups(text: Column, patterns: dict[str, list[str]]) -> Column:
    """Groups with a matching regular expression."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike(one_pattern(ps)), g) for g, ps in patterns.items())))


def one_pattern(ps: list[str]) -> str:
    """A pattern that is found where one of ps is. If all are words (a literal letter or more between
    boundaries), a text is searched for their first letters and the boundary before their alternatives."""
    words = [m for p in ps if (m := re.fullmatch(r"\\b(([a-z])[a-z][^|\\]*|([a-z])[a-z](?:[^|\\()]|\(\?:[^()\\]*\))*)\\b", p))]
    if len(words) < len(ps) or not ps:
        return "|".join(f"(?:{p})" for p in ps)
    first = "".join(sorted({m[2] or m[3] for m in words}))
    return rf"(?=[{first}])\b(?:" + "|".join(m[1] for m in words) + r")\b"


def group_features(o: Column, r: Column, name: str) -> list[Column]:
    """Counts, overlap and changes of one group, from the terms found on both sides."""
    return [
        F.size(o).alias(f"orig_{name}_count"), F.size(r).alias(f"recon_{name}_count"), sets.jaccard(o, r).alias(f"{name}_jaccard"),
        F.size(F.array_except(o, r)).alias(f"{name}_missing_count"), F.size(F.array_except(r, o)).alias(f"{name}_added_count"),
        ((F.size(o) > 0) == (F.size(r) > 0)).alias(f"{name}_presence_preserved"),
        sets.recall_or_null(o, r).alias(f"{name}_recall"), ((F.size(o) == 0) | (F.size(r) > 0)).alias(f"{name}_category_retained"),
    ]


def modal(prohibition: Column, obligation: Column, permission: Column) -> Column:
    return F.when(F.size(prohibition) > 0, "prohibition").when(F.size(obligation) > 0, "obligation").when(F.size(permission) > 0, "permission").otherwise("none")


def modal_groups(groups: Column) -> Column:
    """The modal groups that occur, joined, or none."""
    parts = F.filter(F.array(*map(F.lit, ("permission", "obligation", "prohibition"))), lambda g: F.array_contains(groups, g))
    return F.when(F.size(parts) == 0, "none").otherwise(F.array_join(parts, "+"))


def critical_loss(o: Column, r: Column, critical=CRITICAL) -> Column:
    return F.array_sort(F.array_intersect(F.array_except(o, r), F.array(*map(F.lit, critical))))


def flags(conditions: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(c, name) for name, c in conditions)))


def error_flags(groups: list[str], missing, added, modal_changed: Column, recall: Column, precision: Column, score: Column) -> Column:
    """The error labels of a pair, in their order; missing and added give a group's count."""
    some = lambda count, names: [count(g) > 0 for g in names if g in groups]
    any_of = lambda cs: cs[0] if len(cs) == 1 else F.expr("false") if not cs else any_of([cs[0] | cs[1], *cs[2:]])
    conditions = [("modal_or_permission_category_changed", modal_changed)]
    conditions += [(name, any_of(some(missing, names))) for name, names in DROPPED.items()]
    conditions += [(name, any_of(some(missing, [g]) + some(added, [g]))) for name, g in CHANGED.items()]
    conditions += [("substantial_content_loss", recall < 0.60), ("substantial_added_content", precision < 0.60), ("low_classifier_score", score < 0.50)]
    return flags(conditions)
