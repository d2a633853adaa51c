"""Registered queries of the fixed dictionaries (cue groups, patterns, roles) over whole texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import cues, text
from spanloom.operators import diagnostics
from spanloom.plans import fixtures as fx
from spanloom.plans.catalog import query, r6
from spanloom.plans.diagnose import _STOP, _jac, _minus, _rec

_GROUPS = diagnostics.CUE_GROUPS | diagnostics.EVALUATION_GROUPS
#: Terms of all dictionaries: the tables' prose has few of them, so each pair of texts is given some at its end.
_TERMS = list(dict.fromkeys(t for terms in (*_GROUPS.values(), *text.ROLES.values()) for t in terms))
_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_listed = lambda values: "[" + ", ".join(map(_quoted, values)) + "]"


def _planted(spark, sf_dir):
    """Round trips whose original ends with three terms and whose reconstruction with one of them and a fourth."""
    term = lambda k: F.element_at(F.array(*map(F.lit, _TERMS)), ((F.col("doc_id") + 97 * k) % len(_TERMS) + 1).cast("int"))
    rt = fx.roundtrips(spark, sf_dir).select("doc_id", "condition", "llm", "score", "original_text", "reconstructed_text")
    return rt.withColumns({"original_text": F.concat_ws(" ", "original_text", term(0), term(1), F.lit("zz"), term(2)), "reconstructed_text": F.concat_ws(" ", "reconstructed_text", term(1), F.lit("zz"), term(3))})


_term = lambda k: f"({_listed(_TERMS)})[(doc_id + {97 * k}) % {len(_TERMS)} + 1]"
_PLANTED = f"""{fx.RT}, pl AS (SELECT doc_id, condition, llm, score, concat_ws(' ', original_text, {_term(0)}, {_term(1)}, 'zz', {_term(2)}) AS original_text, concat_ws(' ', reconstructed_text, {_term(1)}, 'zz', {_term(3)}) AS reconstructed_text FROM rt)"""


def _found_sql(side: str, terms: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({side}), {_quoted(cues.pattern(t))}) THEN {_quoted(t)} END" for t in terms) + "], lambda t: t IS NOT NULL)"


_words = lambda side: f"list_distinct(list_filter(regexp_extract_all(lower({side}), '[a-z0-9'']+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t)))"
_lost = lambda names: " OR ".join(f"len({_minus(f'o_{g}', f'r_{g}')}) > 0" for g in names)
_METRICS = f"""{_PLANTED}, f0 AS (SELECT doc_id, score, {_words("original_text")} AS o, {_words("reconstructed_text")} AS r, {", ".join(f"{_found_sql('original_text', t)} AS o_{g}, {_found_sql('reconstructed_text', t)} AS r_{g}" for g, t in _GROUPS.items())} FROM pl),
f1 AS (SELECT *, {_rec("o", "r")} AS recall, {_rec("r", "o")} AS prec, CASE WHEN len(o_prohibition) > 0 THEN 'prohibition' WHEN len(o_obligation) > 0 THEN 'obligation' WHEN len(o_permission) > 0 THEN 'permission' ELSE 'none' END AS modal_orig,
  CASE WHEN len(r_prohibition) > 0 THEN 'prohibition' WHEN len(r_obligation) > 0 THEN 'obligation' WHEN len(r_permission) > 0 THEN 'permission' ELSE 'none' END AS modal_recon FROM f0)"""


@query(f"""WITH {_METRICS} SELECT doc_id, modal_orig, modal_recon, {", ".join(f"len(o_{g}) AS orig_{g}_count, len({_minus(f'o_{g}', f'r_{g}')}) AS {g}_missing_count, len({_minus(f'r_{g}', f'o_{g}')}) AS {g}_added_count, round({_jac(f'o_{g}', f'r_{g}')}, 6) AS {g}_jaccard" for g in _GROUPS)},
  {" + ".join(f"(len(o_{g}) > 0)::INT" for g in _GROUPS)} AS important_category_orig_count, round(({" + ".join(f"len(list_intersect(o_{g}, r_{g}))" for g in _GROUPS)}) / nullif({" + ".join(f"len(o_{g})" for g in _GROUPS)}, 0), 6) AS important_cue_exact_recall,
  concat_ws('; ', CASE WHEN modal_orig <> modal_recon THEN 'modal_or_permission_category_changed' END, {", ".join(f"CASE WHEN {_lost(gs)} THEN '{n}' END" for n, gs in cues.DROPPED.items())},
  {", ".join(f"CASE WHEN len({_minus(f'o_{g}', f'r_{g}')}) > 0 OR len({_minus(f'r_{g}', f'o_{g}')}) > 0 THEN '{n}' END" for n, g in cues.CHANGED.items())},
  CASE WHEN recall < 0.6 THEN 'substantial_content_loss' END, CASE WHEN prec < 0.6 THEN 'substantial_added_content' END, CASE WHEN score < 0.5 THEN 'low_classifier_score' END) AS suspected_error_flags FROM f1""")
def d_dictionary_metrics(spark, sf_dir):
    m = diagnostics.row_metrics(_planted(spark, sf_dir), _GROUPS, "original_text", "reconstructed_text", "score")
    counts = [c for g in _GROUPS for c in (f"orig_{g}_count", f"{g}_missing_count", f"{g}_added_count")]
    ratios = [*(f"{g}_jaccard" for g in _GROUPS), "important_cue_exact_recall"]
    return m.select("doc_id", "modal_orig", "modal_recon", *(F.col(c).cast("long").alias(c) for c in counts), *(r6(F.col(c).cast("double")).alias(c) for c in ratios), "important_category_orig_count", "suspected_error_flags")


_pattern_sql = lambda side: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({side}), {_quoted('|'.join(ps))}) THEN '{g}' END" for g, ps in sorted(cues.PATTERNS.items())) + "], lambda g: g IS NOT NULL)"
_PRESERVED = f"""{_PLANTED}, q0 AS (SELECT doc_id, condition, {_pattern_sql("original_text")} AS o, {_pattern_sql("reconstructed_text")} AS r FROM pl),
q AS (SELECT *, {_minus("o", "r")} AS miss, {_minus("r", "o")} AS added, CASE WHEN len(o) = 0 THEN 1.0 ELSE len(list_intersect(o, r)) / len(o) END AS rec FROM q0)"""


def _preserved(spark, sf_dir):
    return diagnostics.cue_preservation(_planted(spark, sf_dir), cues.PATTERNS, "original_text", "reconstructed_text")


@query(f"""WITH {_PRESERVED} SELECT doc_id, array_to_string(o, ';') AS orig_cue_groups, array_to_string(r, ';') AS recon_cue_groups, array_to_string(miss, ';') AS missing_cue_groups, array_to_string(added, ';') AS added_cue_groups, round(rec, 6) AS cue_group_recall, round({_jac("o", "r")}, 6) AS cue_group_jaccard,
  array_to_string(list_filter(miss, lambda g: list_contains({_listed(cues.CRITICAL)}, g)), ';') AS critical_missing FROM q""")
def d_dictionary_patterns(spark, sf_dir):
    lists = ["orig_cue_groups", "recon_cue_groups", "missing_cue_groups", "added_cue_groups", "critical_missing"]
    return _preserved(spark, sf_dir).select("doc_id", *(F.array_join(F.array_sort(c), ";").alias(c) for c in lists), *(r6(c).alias(c) for c in ("cue_group_recall", "cue_group_jaccard")))


@query(f"""WITH {_PRESERVED}, u AS (SELECT condition, g AS cue_group, list_contains(o, g) AS a, list_contains(r, g) AS b FROM q, (SELECT unnest({_listed(cues.PATTERNS)}) AS g))
SELECT condition, cue_group, count(*) AS n, count(*) FILTER (a) AS n_original_present, round(avg(b::INT) FILTER (a), 6) AS preservation_rate, round(count(*) FILTER (NOT a AND b) / greatest(1, count(*) FILTER (NOT a)), 6) AS addition_rate FROM u GROUP BY ALL""")
def d_dictionary_rates(spark, sf_dir):
    c = diagnostics.cue_rates(_preserved(spark, sf_dir), list(cues.PATTERNS), ["condition"])
    return c.select("condition", "cue_group", "n", "n_original_present", *(r6(x).alias(x) for x in ("preservation_rate", "addition_rate")))


_share = lambda ws: f"len(list_intersect(w, {_listed(ws)}))"
_most = f"greatest({', '.join(map(_share, text.ROLES.values()))})"


@query(f"""WITH {_PLANTED}, w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(reconstructed_text), '[a-z0-9'']+')) AS w FROM pl)
SELECT doc_id, CASE WHEN {_most} = 0 THEN 'other' {' '.join(f"WHEN {_share(ws)} = {_most} THEN '{r}'" for r, ws in text.ROLES.items())} END AS role FROM w""")
def c_roles(spark, sf_dir):
    return _planted(spark, sf_dir).select("doc_id", text.role(text.tokens(F.col("reconstructed_text")), text.ROLES).alias("role"))
