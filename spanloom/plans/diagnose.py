"""Registered queries of the diagnostics, comparisons and reshapes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import jsonish
from spanloom.operators import crosswalk, diagnostics, relational
from spanloom.plans import fixtures as fx
from spanloom.plans.catalog import _cue_columns, query, r6
from spanloom.session import spread, table

_STOP = "[" + ", ".join(f"'{w}'" for w in diagnostics.STOP) + "]"
_G = list(fx.CUES)


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def _rec(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / nullif(len({a}), 0)"


def _minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda t: NOT list_contains({b}, t))"


_CRIT = {"condition_scope_or_exception_cue_dropped": ["condition", "restriction", "exception"], "prohibition_cue_dropped": ["prohibition"], "negation_cue_dropped": ["negation"], "withdrawal_choice_cue_dropped": ["withdrawal"]}
_CHG = {"governed_action_changed": "action", "governed_resource_changed": "resource", "actor_or_recipient_changed": "actor", "purpose_or_use_context_changed": "purpose"}
_ROW = f"""{fx.RT}, c0 AS (SELECT doc_id, condition, meaning_preserved, score, list_distinct(list_filter(tk, lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))) AS o, list_distinct(list_filter(rk, lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))) AS r, {_cue_columns()} FROM rt),
c1 AS (SELECT *, {_rec("o", "r")} AS recall, {_rec("r", "o")} AS prec, list_distinct(list_concat(list_concat(o_prohibition, o_obligation), o_permission)) AS mo, list_distinct(list_concat(list_concat(r_prohibition, r_obligation), r_permission)) AS mr,
  CASE WHEN len(o_prohibition) > 0 THEN 'prohibition' WHEN len(o_obligation) > 0 THEN 'obligation' WHEN len(o_permission) > 0 THEN 'permission' ELSE 'none' END AS modal_orig,
  CASE WHEN len(r_prohibition) > 0 THEN 'prohibition' WHEN len(r_obligation) > 0 THEN 'obligation' WHEN len(r_permission) > 0 THEN 'permission' ELSE 'none' END AS modal_recon,
  {" + ".join(f"(len(o_{g}) > 0)::INT" for g in _G)} AS has, {" + ".join(f"(len(o_{g}) > 0 AND len(r_{g}) > 0)::INT" for g in _G)} AS kept,
  {" + ".join(f"len(o_{g})" for g in _G)} AS cues_o, {" + ".join(f"len(list_intersect(o_{g}, r_{g}))" for g in _G)} AS cues_both FROM c0),
row AS (SELECT *, concat_ws('; ', CASE WHEN modal_orig <> modal_recon THEN 'modal_or_permission_category_changed' END,
  {", ".join(f"CASE WHEN {' OR '.join(f'len({_minus(f'o_{g}', f'r_{g}')}) > 0' for g in _CRIT[n])} THEN '{n}' END" for n in ("prohibition_cue_dropped", "negation_cue_dropped", "condition_scope_or_exception_cue_dropped", "withdrawal_choice_cue_dropped"))},
  {", ".join(f"CASE WHEN len({_minus(f'o_{g}', f'r_{g}')}) > 0 OR len({_minus(f'r_{g}', f'o_{g}')}) > 0 THEN '{n}' END" for n, g in _CHG.items())},
  CASE WHEN recall < 0.6 THEN 'substantial_content_loss' END, CASE WHEN prec < 0.6 THEN 'substantial_added_content' END, CASE WHEN score < 0.5 THEN 'low_classifier_score' END) AS flags FROM c1)"""


def _metrics(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir)
    return diagnostics.row_metrics(rt.select("doc_id", "condition", "meaning_preserved", "score", "original_text", "reconstructed_text"), fx.CUES, "original_text", "reconstructed_text", "score")


@query(f"""WITH {_ROW} SELECT doc_id, len(o) AS orig_content_word_count, len({_minus("o", "r")}) AS missing_content_word_count, array_to_string(list_sort({_minus("o", "r")}), '; ') AS missing_content_words, round(recall, 6) AS content_word_recall, round(prec, 6) AS content_word_precision,
  round(CASE WHEN recall + prec = 0 THEN 0 ELSE 2 * recall * prec / (recall + prec) END, 6) AS content_word_f1, round({_jac("o", "r")}, 6) AS content_word_jaccard, round(len({_minus("o", "r")}) / nullif(len(o), 0), 6) AS dropped_content_word_rate, has AS important_category_orig_count, kept AS important_category_retained_count,
  round(kept / nullif(has, 0), 6) AS important_category_presence_recall, round(cues_both / nullif(cues_o, 0), 6) AS important_cue_exact_recall, modal_orig, modal_recon, round({_jac("mo", "mr")}, 6) AS modal_word_jaccard, round({_rec("mo", "mr")}, 6) AS modal_word_recall, round(1 - {_jac("mo", "mr")}, 6) AS modal_word_change_ratio,
  array_to_string(list_sort({_minus("mo", "mr")}), '; ') AS modal_missing_cues, round({_rec("o_action", "r_action")}, 6) AS action_recall, array_to_string(list_sort(o_purpose), '; ') AS orig_purpose_cues, flags AS suspected_error_flags, len(list_filter(string_split(flags, '; '), lambda x: x <> '')) AS suspected_error_count FROM row""")
def d_row_metrics(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    ratios = ["content_word_recall", "content_word_precision", "content_word_f1", "content_word_jaccard", "dropped_content_word_rate", "important_category_presence_recall", "important_cue_exact_recall", "modal_word_jaccard", "modal_word_recall", "modal_word_change_ratio", "action_recall"]
    counts = ["orig_content_word_count", "missing_content_word_count", "suspected_error_count"]
    return m.select("doc_id", *(F.col(c).cast("long").alias(c) for c in counts), *(r6(F.col(c).cast("double")).alias(c) for c in ratios), "missing_content_words", "important_category_orig_count", "important_category_retained_count", "modal_orig", "modal_recon", "modal_missing_cues", "orig_purpose_cues", "suspected_error_flags")


@query(f"""WITH {_ROW}, u AS ({" UNION ALL ".join(f"SELECT condition, '{g}' AS cue_group, len(o_{g}) AS o, len(r_{g}) AS r, {_rec(f'o_{g}', f'r_{g}')} AS rec, len({_minus(f'o_{g}', f'r_{g}')}) AS miss FROM row" for g in _G)})
SELECT condition, cue_group, count(*) AS n_rows, count(*) FILTER (o > 0) AS n_rows_with_original_cue, round(avg((o > 0)::INT), 6) AS original_cue_prevalence, round(avg(CASE WHEN o > 0 THEN (r > 0)::INT END), 6) AS category_presence_retention_rate, round(avg(CASE WHEN o > 0 THEN rec END), 6) AS mean_exact_cue_recall, round(avg(miss), 6) AS mean_missing FROM u GROUP BY ALL""")
def d_cue_summary(spark, sf_dir):
    s = diagnostics.cue_summary(_metrics(spark, sf_dir), _G, ["condition"])
    return s.select("condition", "cue_group", "n_rows", "n_rows_with_original_cue", *(r6(c).alias(c) for c in ("original_cue_prevalence", "category_presence_retention_rate", "mean_exact_cue_recall", "mean_missing")))


@query(f"""WITH {_ROW}, u AS ({" UNION ALL ".join(f"SELECT meaning_preserved AS label, '{g}' AS cue_group, len(o_{g}) AS o, len(r_{g}) AS r, {_jac(f'o_{g}', f'r_{g}')} AS j FROM row" for g in _G)})
SELECT cue_group, label, count(*) AS n, round(avg((o > 0)::INT), 6) AS share_original, round(avg((r > 0)::INT), 6) AS share_reconstructed, round(avg(o), 6) AS mean_original, round(avg(j), 6) AS mean_jaccard FROM u GROUP BY ALL""")
def d_cue_frequencies(spark, sf_dir):
    f = diagnostics.cue_frequencies(_metrics(spark, sf_dir), _G, "meaning_preserved")
    return f.select("cue_group", "label", "n", *(r6(c).alias(c) for c in ("share_original", "share_reconstructed", "mean_original", "mean_jaccard")))


_DIFF = ["content_word_recall", "content_word_jaccard", "modal_word_jaccard"]


@query(f"""WITH {_ROW}, u AS (SELECT meaning_preserved AS y, unnest(['content_word_recall', 'content_word_jaccard', 'modal_word_jaccard']) AS feature, unnest([recall, {_jac("o", "r")}, {_jac("mo", "mr")}]) AS x FROM row)
SELECT feature, round(avg(x) FILTER (y = 1), 6) AS mean_1, round(avg(x) FILTER (y = 0), 6) AS mean_0, round(avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0), 6) AS difference FROM u GROUP BY feature""")
def j_mean_difference(spark, sf_dir):
    m = relational.mean_difference(_metrics(spark, sf_dir), "meaning_preserved", _DIFF)
    return m.select("feature", *(r6(c).alias(c) for c in ("mean_1", "mean_0", "difference")))


# Pattern groups: three of them in terms of the tables' prose, named as critical groups are

_PATTERNS = {"permission": [r"\bis\b", r"\bare\b"], "obligation": [r"\bwas\b", r"\bbe\b"], "prohibition": [r"\bonly\b"], "condition": [r"\bwhen\b", r"\bas\b"], "action": [r"\bon\b"]}
_PAT_SQL = lambda side: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({side}, '{'|'.join(ps)}') THEN '{g}' END" for g, ps in sorted(_PATTERNS.items())) + "], lambda g: g IS NOT NULL)"
_CUES = f"""{fx.RT}, p0 AS (SELECT doc_id, condition, llm, score, {_PAT_SQL("original_text")} AS o, {_PAT_SQL("reconstructed_text")} AS r FROM rt),
p1 AS (SELECT *, {_minus("o", "r")} AS miss, CASE WHEN len(o) = 0 THEN 1.0 ELSE len(list_intersect(o, r)) / len(o) END AS rec, CASE WHEN len(r) = 0 THEN CASE WHEN len(o) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(o, r)) / len(r) END AS prec,
  coalesce(nullif(array_to_string(list_filter(['permission', 'obligation', 'prohibition'], lambda g: list_contains(o, g)), '+'), ''), 'none') AS mo, coalesce(nullif(array_to_string(list_filter(['permission', 'obligation', 'prohibition'], lambda g: list_contains(r, g)), '+'), ''), 'none') AS mr FROM p0),
pres AS (SELECT *, list_filter(miss, lambda g: g <> 'action') AS crit FROM p1)"""


def _preserved(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir).select("doc_id", "condition", "llm", "score", "original_text", "reconstructed_text")
    return diagnostics.cue_preservation(rt, _PATTERNS, "original_text", "reconstructed_text")


@query(f"""WITH {_CUES} SELECT doc_id, array_to_string(o, ';') AS orig_cue_groups, array_to_string(miss, ';') AS missing_cue_groups, round(rec, 6) AS cue_group_recall, round(prec, 6) AS cue_group_precision, round(CASE WHEN rec + prec = 0 THEN 0 ELSE 2 * rec * prec / (rec + prec) END, 6) AS cue_group_f1, round({_jac("o", "r")}, 6) AS cue_group_jaccard,
  mo AS modal_category_original, mr AS modal_category_reconstruction, mo <> mr AS modal_category_changed, array_to_string(crit, ';') AS critical_missing, len(crit) > 0 AS audit_critical_cue_missing FROM pres""")
def d_cue_preservation(spark, sf_dir):
    p = _preserved(spark, sf_dir)
    lists = ["orig_cue_groups", "missing_cue_groups", "critical_missing"]
    return p.select("doc_id", *(F.array_join(c, ";").alias(c) for c in lists), *(r6(c).alias(c) for c in ("cue_group_recall", "cue_group_precision", "cue_group_f1", "cue_group_jaccard")), "modal_category_original", "modal_category_reconstruction", "modal_category_changed", "audit_critical_cue_missing")


@query(f"""WITH {_CUES}, u AS (SELECT condition, g AS cue_group, list_contains(o, g) AS a, list_contains(r, g) AS b FROM pres, (SELECT unnest({list(_PATTERNS)}) AS g))
SELECT condition, cue_group, count(*) AS n, count(*) FILTER (a) AS n_original_present, round(avg(b::INT) FILTER (a), 6) AS preservation_rate, round(avg((NOT b)::INT) FILTER (a), 6) AS loss_rate, round(count(*) FILTER (NOT a AND b) / greatest(1, count(*) FILTER (NOT a)), 6) AS addition_rate FROM u GROUP BY ALL""")
def d_cue_rates(spark, sf_dir):
    c = diagnostics.cue_rates(_preserved(spark, sf_dir), list(_PATTERNS), ["condition"])
    return c.select("condition", "cue_group", "n", "n_original_present", *(r6(x).alias(x) for x in ("preservation_rate", "loss_rate", "addition_rate")))


@query(f"WITH {_CUES} SELECT doc_id FROM pres WHERE score >= 0.75 AND (len(crit) > 0 OR rec < 0.7)")
def d_high_risk(spark, sf_dir):
    return diagnostics.high_risk(_preserved(spark, sf_dir)).select("doc_id")


@query(f"WITH {_CUES} SELECT doc_id, round(rec, 6) AS cue_group_recall FROM pres ORDER BY rec, score DESC, doc_id LIMIT 250")
def d_lowest(spark, sf_dir):
    return diagnostics.lowest(_preserved(spark, sf_dir), "score", "doc_id").select("doc_id", r6("cue_group_recall").alias("cue_group_recall"))


@query(f"WITH {_CUES} SELECT condition, count(*) AS n, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score, round(avg(rec), 6) AS mean_cue_group_recall, round(avg((mo <> mr)::INT), 6) AS pct_modal_category_changed FROM pres GROUP BY condition")
def d_condition_summary(spark, sf_dir):
    s = diagnostics.condition_summary(_preserved(spark, sf_dir), ["condition", "absent"], ["score", "cue_group_recall", "absent"], ["score"], ["modal_category_changed", "absent"])
    return s.select("condition", "n", *(r6(c).alias(c) for c in ("mean_score", "median_score", "mean_cue_group_recall", "pct_modal_category_changed")))


@query(f"WITH {_CUES} SELECT 'all' AS \"__all__\", count(*) AS n, round(avg(score), 6) AS mean_score FROM pres")
def j_ungrouped(spark, sf_dir):
    return diagnostics.condition_summary(_preserved(spark, sf_dir), ["absent"], ["score"]).withColumn("mean_score", r6("mean_score"))


# Elements

_REC = f"""{fx.RT}, {fx.ANN}, rec AS (SELECT doc_id, 's' || doc_id // 2 AS sentence, (pos - 1) // 3 AS k, CASE WHEN doc_id % 5 = 0 AND pos = 1 THEN 'DUO::DUO.decision' ELSE label END AS union_element_id, span, llm, condition, score, (['permit', 'deny', ''])[doc_id % 3 + 1] AS value FROM spans)"""


def _records(spark, sf_dir):
    d = F.col("doc_id")
    uid = F.when((d % 5 == 0) & (F.col("ann_idx") == 0), "DUO::DUO.decision").otherwise(F.col("label"))
    value = F.element_at(F.array(*map(F.lit, ("permit", "deny", ""))), (d % 3 + 1).cast("int"))
    return fx.spans(spark, sf_dir).select("doc_id", F.concat(F.lit("s"), F.floor(d / 2)).alias("sentence"), F.col("ann_idx").alias("k"), uid.alias("union_element_id"), "span", "llm", "condition", "score", value.alias("value"))


@query(f"WITH {_REC}, {fx.INV} SELECT doc_id, k, rec.union_element_id, CASE WHEN rec.union_element_id = 'DUO::DUO.decision' OR i.union_element_id IS NOT NULL THEN 'sentence_level_decision' ELSE 'span_annotation' END AS element_kind FROM rec LEFT JOIN inv i ON i.union_element_id = rec.union_element_id AND i.source_order = 2")
def u_element_kinds(spark, sf_dir):
    inv = fx.inventory(spark, sf_dir).withColumn("element_scope", F.when(F.col("source_order") == 2, "Sentence").when(F.col("source_order") == 3, "").otherwise("span"))
    return diagnostics.element_records(_records(spark, sf_dir), inv).select("doc_id", "k", "union_element_id", "element_kind")


@query(f"""WITH {_REC}, t AS (SELECT union_element_id, span, row_number() OVER (PARTITION BY union_element_id ORDER BY count(*) DESC, span) AS r FROM rec WHERE span <> '' GROUP BY union_element_id, span),
b AS (SELECT union_element_id, string_agg(span, ';' ORDER BY r) AS top FROM t WHERE r <= 8 GROUP BY union_element_id)
SELECT union_element_id, count(*) AS n_mentions, count(DISTINCT sentence) AS n_source_sentences, count(DISTINCT llm) AS n_llms, count(DISTINCT condition) AS n_conditions, round(avg(score), 6) AS mean_score, any_value(top) AS top_spans FROM rec LEFT JOIN b USING (union_element_id) GROUP BY union_element_id""")
def n_element_summary(spark, sf_dir):
    s = diagnostics.element_summary(_records(spark, sf_dir), "union_element_id", "sentence", ["score"])
    return s.withColumn("mean_score", r6("mean_score")).withColumn("top_spans", F.array_join("top_spans", ";"))


@query(f"""WITH {_REC}, g AS (SELECT sentence, llm, condition, avg(score) AS s FROM rec GROUP BY ALL), e AS (SELECT DISTINCT sentence, llm, condition, union_element_id AS u FROM rec)
SELECT x.u AS a, y.u AS b, count(*) AS n_cooccurrences, count(DISTINCT x.sentence) AS n_source_sentences, round(avg(g.s), 6) AS mean_score FROM e x JOIN e y ON x.sentence = y.sentence AND x.llm = y.llm AND x.condition = y.condition AND x.u < y.u JOIN g ON g.sentence = x.sentence AND g.llm = x.llm AND g.condition = x.condition GROUP BY ALL""")
def n_element_pairs(spark, sf_dir):
    return diagnostics.element_pairs(_records(spark, sf_dir), "union_element_id", "sentence", "score", ["llm", "condition"]).withColumn("mean_score", r6("mean_score"))


@query(f"""WITH {_REC}, v AS (SELECT llm, condition, value, count(*) AS n FROM rec WHERE value <> '' GROUP BY ALL), t AS (SELECT llm, condition, string_agg(value || ':' || n, ';' ORDER BY n DESC, value) AS top FROM v GROUP BY ALL)
SELECT llm, condition, count(*) AS n_mentions, count(DISTINCT sentence) AS n_source_sentences, round(avg(score), 6) AS mean_score, any_value(top) AS top_values FROM rec LEFT JOIN t USING (llm, condition) GROUP BY ALL""")
def r_decision_summary(spark, sf_dir):
    s = diagnostics.decision_summary(_records(spark, sf_dir), ["llm", "condition"], "sentence", "value", "score")
    return s.withColumn("mean_score", r6("mean_score")).withColumn("top_values", F.array_join("top_values", ";"))


_GRAN = f"""{fx.RT}, s AS (SELECT doc_id, llm, original_text AS t, len(tk) AS n, list_filter([array_to_string(tk[1:9 + doc_id % 6], ' '), coalesce(tk[4], ''), array_to_string(tk[3:5], ' '), 'nowhere to be found', CASE WHEN doc_id % 9 = 0 THEN original_text ELSE '' END], lambda x: x <> '') AS sp, doc_id % 2 + 1 AS labels FROM rt),
p AS (SELECT *, list_transform(sp, lambda x: len(regexp_extract_all(x, '[A-Za-z0-9'']+'))) AS k, list_transform(sp, lambda x: strpos(t, x)) AS st FROM s),
c AS (SELECT *, flatten(list_transform(range(1, len(sp) + 1), lambda i: CASE WHEN st[i] = 0 THEN [] ELSE range(len(string_split(substr(t, 1, st[i]), ' ')), len(string_split(substr(t, 1, st[i] + length(sp[i]) - 1), ' ')) + 1) END)) AS met FROM p),
g AS (SELECT doc_id, llm, n AS source_token_count, 5 AS n_annotations, labels AS n_unique_labels, 5 / greatest(1, n) AS annotation_density, coalesce(list_max(k), 0) AS max_span_tokens, len(list_filter(k, lambda x: x >= 8)) AS n_long_spans, len(list_filter(k, lambda x: x >= 12)) AS n_clause_spans, coalesce(list_sum(k), 0) / greatest(1, len(k)) AS mean_span_tokens,
  len(list_filter(range(1, len(k) + 1), lambda i: k[i] / greatest(1, n) >= 0.8 OR sp[i] = t)) AS n_full_sentence_spans, len(list_distinct(met)) / greatest(1, n) AS token_coverage, (len(met) + coalesce(list_sum(list_transform(range(1, len(k) + 1), lambda i: CASE WHEN st[i] = 0 THEN k[i] ELSE 0 END)), 0)) / greatest(1, len(list_distinct(met))) AS duplicate_coverage FROM c)"""


def _gran(spark, sf_dir):
    """Annotations of whole texts: the first words, the fourth, the third to fifth, words that are not there, and at times all."""
    d, t = F.col("doc_id"), F.col("original_text")
    part = lambda a, n: F.array_join(F.slice("tk", a, n), " ")
    found = F.array(part(1, 9 + d.cast("int") % 6), F.coalesce(F.try_element_at("tk", F.lit(4)), F.lit("")), part(3, 3), F.lit("nowhere to be found"), F.when(d % 9 == 0, t).otherwise(""))
    labels = F.array(F.lit("A"), F.when(d % 2 == 1, "B").otherwise("A"), F.lit("A"), F.lit(""), F.lit(""))
    return diagnostics.granularity(fx.roundtrips(spark, sf_dir).select("doc_id", "llm", t.alias("t"), found.alias("sp"), labels.alias("lb")), "t", "sp", "lb")


_GRAN_COUNTS = ["source_token_count", "n_annotations", "n_unique_labels", "max_span_tokens", "n_long_spans", "n_clause_spans", "n_full_sentence_spans"]
_GRAN_RATIOS = ["annotation_density", "mean_span_tokens", "token_coverage", "duplicate_coverage"]


@query(f"WITH {_GRAN} SELECT doc_id, {', '.join(_GRAN_COUNTS)}, {', '.join(f'round({c}, 6) AS {c}' for c in _GRAN_RATIOS)} FROM g")
def r_granularity(spark, sf_dir):
    return _gran(spark, sf_dir).select("doc_id", *(F.col(c).cast("long").alias(c) for c in _GRAN_COUNTS), *(r6(c).alias(c) for c in _GRAN_RATIOS))


@query(f"WITH {_GRAN} SELECT llm, count(*) AS n_rows, round(avg(annotation_density), 6) AS mean_annotation_density, round(median(annotation_density), 6) AS median_annotation_density, round(avg((n_long_spans > 0)::INT), 6) AS pct_rows_with_long_span FROM g GROUP BY llm")
def r_granularity_summary(spark, sf_dir):
    g = diagnostics.granularity_summary(_gran(spark, sf_dir), ["llm"], ["annotation_density"])
    return g.select("llm", "n_rows", *(r6(c).alias(c) for c in ("mean_annotation_density", "median_annotation_density", "pct_rows_with_long_span")))


# Comparisons

_PAIRED = f"{fx.RT}, k AS (SELECT form_id AS source_id, llm, condition, avg(score) AS score FROM rt GROUP BY ALL), u AS (SELECT * FROM k WHERE condition = 'cond0')"


def _kinds(spark, sf_dir):
    return fx.roundtrips(spark, sf_dir).groupBy(F.col("form_id").alias("source_id"), "llm", "condition").agg(F.avg("score").alias("score"))


_RATES = "count(*) AS n_pairs, round(avg(u.score - x.score), 6) AS mean_delta, round(median(u.score - x.score), 6) AS median_delta, round(avg((u.score > x.score)::INT), 6) AS win_rate, round(avg((u.score < x.score)::INT), 6) AS loss_rate, round(avg((u.score = x.score)::INT), 6) AS tie_rate"
_RATE_NAMES = ("mean_delta", "median_delta", "win_rate", "loss_rate", "tie_rate")


@query(f"WITH {_PAIRED} SELECT llm, x.condition AS other, {_RATES} FROM u JOIN k x USING (llm, source_id) WHERE x.condition <> 'cond0' GROUP BY ALL")
def i_paired(spark, sf_dir):
    p = relational.paired(_kinds(spark, sf_dir), ["llm", "source_id"], "condition", "cond0", F.col("condition") != "cond0", ["score"])
    return relational.win_rates(p, ["llm", "other"], "score").select("llm", "other", "n_pairs", *(r6(c).alias(c) for c in _RATE_NAMES))


@query(f"WITH {_PAIRED}, x AS (SELECT llm, source_id, max(score) AS score FROM k WHERE condition <> 'cond0' GROUP BY ALL) SELECT llm, {_RATES} FROM u JOIN x USING (llm, source_id) GROUP BY llm")
def i_best_other(spark, sf_dir):
    k = _kinds(spark, sf_dir)
    best = relational.best_other(k, ["llm", "source_id"], F.col("condition") != "cond0", "score", "condition").withColumn("condition", F.lit("best"))
    p = relational.paired(k.filter("condition = 'cond0'").unionByName(best.select(*k.columns)), ["llm", "source_id"], "condition", "cond0", F.col("condition") == "best", ["score"])
    return relational.win_rates(p, ["llm"], "score").select("llm", "n_pairs", *(r6(c).alias(c) for c in _RATE_NAMES))


_XW = "manual AS (SELECT DISTINCT lang AS source_model, 'e' || doc_id % 6 AS source_element, 'field' || doc_id % 3 AS manual_field FROM documents WHERE doc_id % 6 <> 5), induced AS (SELECT DISTINCT lang AS source_model, 'e' || doc_id % 7 AS source_element, 'c' || doc_id % 2 AS induced_field, 'fold_0' || doc_id % 2 AS fold FROM documents WHERE doc_id % 7 <> 0)"


def _crosswalks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = lambda n: F.col("doc_id") % n
    manual = d.filter(k(6) != 5).select(F.col("lang").alias("source_model"), F.concat(F.lit("e"), k(6)).alias("source_element"), F.concat(F.lit("field"), k(3)).alias("manual_field")).distinct()
    induced = d.filter(k(7) != 0).select(F.col("lang").alias("source_model"), F.concat(F.lit("e"), k(7)).alias("source_element"), F.concat(F.lit("c"), k(2)).alias("induced_field"), F.concat(F.lit("fold_0"), k(2)).alias("fold")).distinct()
    return manual, induced


@query(f"WITH {_XW} SELECT manual_field, induced_field, count(DISTINCT source_element) AS n_source_elements, count(DISTINCT source_model) AS n_source_models, coalesce(string_agg(DISTINCT fold, '; ' ORDER BY fold), '') AS folds FROM manual FULL JOIN induced USING (source_model, source_element) GROUP BY ALL")
def i_outer_alignment(spark, sf_dir):
    return crosswalk.alignment(*_crosswalks(spark, sf_dir), ["source_model", "source_element"], "manual_field", "induced_field", "fold")


@query(f"WITH {_XW}, m AS (SELECT source_model, source_element, string_agg(DISTINCT manual_field, '; ' ORDER BY manual_field) AS a FROM manual GROUP BY ALL), l AS (SELECT source_model, source_element, string_agg(DISTINCT induced_field, '; ' ORDER BY induced_field) AS b FROM induced GROUP BY ALL) SELECT source_model, source_element, a AS manual_field, b AS induced_field FROM m FULL JOIN l USING (source_model, source_element)")
def r_combined_crosswalk(spark, sf_dir):
    manual, induced = _crosswalks(spark, sf_dir)
    return crosswalk.combined(manual, induced.drop("fold"), ["source_model", "source_element"])


@query(f"WITH {_XW} SELECT source_model, source_element, fold, induced_field, CASE WHEN induced_field = 'c1' THEN 'consensus one ' || fold END AS consensus FROM induced")
def i_consensus(spark, sf_dir):
    _, induced = _crosswalks(spark, sf_dir)
    known = induced.select("fold", "induced_field").distinct().filter("induced_field = 'c1'").withColumn("consensus", F.concat(F.lit("consensus one "), "fold"))
    return induced.join(known, ["fold", "induced_field"], "left").select("source_model", "source_element", "fold", "induced_field", "consensus")


@query("""WITH f AS (SELECT DISTINCT 'f' || n AS field_id, ['alpha beta gamma', 'beta delta epsilon', 'gamma delta zeta alpha'][n + 1] AS t FROM range(3) r(n)), c AS (SELECT item_id, ['alpha', 'beta', 'gamma', 'delta', 'epsilon', 'zeta'][item_id % 6 + 1] AS a, ['gamma', 'delta', 'alpha', 'beta', 'zeta', 'epsilon'][item_id // 6 % 6 + 1] AS b FROM benchmark),
s AS (SELECT field_id, item_id, (SELECT count(DISTINCT x) FROM (SELECT unnest([a, b]) AS x) WHERE contains(' ' || t || ' ', ' ' || x || ' ')) AS score FROM f, c) SELECT field_id, item_id, score FROM s WHERE score >= 2 QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY score DESC, item_id) <= 3""")
def i_fallback_cards(spark, sf_dir):
    fields = spark.sql("SELECT * FROM VALUES ('f0', 'alpha beta gamma'), ('f1', 'beta delta epsilon'), ('f2', 'gamma delta zeta alpha') AS t(field_id, t)")
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    i = F.col("item_id")
    cards = table(spark, sf_dir, "benchmark").select("item_id", F.array(at(("alpha", "beta", "gamma", "delta", "epsilon", "zeta"), i % 6), at(("gamma", "delta", "alpha", "beta", "zeta", "epsilon"), F.floor(i / 6) % 6)).alias("terms"))
    return crosswalk.fallback(fields, "field_id", "t", cards, "item_id", "terms", 2, 3)


_LABEL = "CASE source_order % 6 WHEN 0 THEN 'data record' WHEN 1 THEN 'use of it' WHEN 2 THEN 'consent decision' WHEN 3 THEN 'future period' WHEN 4 THEN 'nothing' ELSE 'study team' END"


@query(f"WITH {fx.INV}, x AS (SELECT union_element_id, {crosswalk.rule_sql('union_element_id', 'source_model', 't', chr(39) * 2)} AS rule FROM (SELECT *, {_LABEL} AS t FROM inv)) SELECT union_element_id, split_part(rule, '|', 1) AS field, split_part(rule, '|', 2) AS mapping_type FROM x")
def b_rule_cascade(spark, sf_dir):
    n = F.col("source_order") % 6
    words = F.when(n == 0, "data record").when(n == 1, "use of it").when(n == 2, "consent decision").when(n == 3, "future period").when(n == 4, "nothing").otherwise("study team")
    inv = fx.inventory(spark, sf_dir).withColumn("source_element_label", words).withColumn("source_element_definition", F.lit(""))
    return crosswalk.build(inv).select("union_element_id", F.col("v1_field").alias("field"), "mapping_type")


# A crosswalk over all documents: each is an element of one of five models, under a name that rules know or a
# neutral one, labelled with a word of the rules or none; its definition is its whole text, or nothing.

_MODELS = ("ODRL", "FHIR_Consent", "DUO", "ICO", "Other")
_NAMES = sorted({x for r in crosswalk.RULES for x in r.names + r.in_name} | {"duo.decision", "x1", "x2"})
_SAID = sorted({x for r in crosswalk.RULES for x in r.in_text} | {"the decision", "Zzz"})
_SCHEMA = sorted({r.field for r in crosswalk.RULES} - {"temporal_scope", "authorized_actor"})
_sql_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_ELEMENTS = f"""el AS (SELECT m || '::' || ({_sql_list(_NAMES)})[doc_id // 5 % {len(_NAMES)} + 1] AS uid, CASE WHEN doc_id % 3 = 0 THEN '' ELSE m END AS given, m, doc_id,
  CASE WHEN doc_id % 2 = 0 THEN ({_sql_list(_SAID)})[doc_id // 2 % {len(_SAID)} + 1] ELSE '' END AS label, CASE WHEN doc_id % 4 = 3 THEN trim(regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', ' ', 'g')) ELSE '' END AS def
  FROM (SELECT *, ({_sql_list(_MODELS)})[doc_id % 5 + 1] AS m FROM documents)),
xr AS (SELECT doc_id, uid, m, {crosswalk.rule_sql("uid", "m", "label", "def")} AS rule FROM el),
xf AS (SELECT doc_id, uid, m, split_part(rule, '|', 1) AS f, split_part(rule, '|', 2) AS k, split_part(rule, '|', 3) AS also, split_part(rule, '|', 4) AS note FROM xr),
xw AS (SELECT doc_id, uid AS union_element_id, m AS information_model, CASE WHEN ok THEN f ELSE 'residual_important_content' END AS v1_field, CASE WHEN ok THEN k ELSE 'needs_expert_review' END AS mapping_type,
  array_to_string(list_filter(string_split(also, ';'), lambda x: x IN {tuple([*_SCHEMA, "sentence_decision"])}), ';') AS secondary_fields, CASE WHEN ok THEN note ELSE '{crosswalk.NOT_IN_SCHEMA}' END AS rationale,
  CASE WHEN ok THEN k ELSE 'needs_expert_review' END IN {crosswalk.REVIEW} AS requires_context_review FROM (SELECT *, f IN {tuple([*_SCHEMA, "sentence_decision"])} AS ok FROM xf))"""


def _elements(spark, sf_dir):
    d = F.col("doc_id")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    model = pick(_MODELS, d % len(_MODELS))
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.concat(model, F.lit("::"), pick(_NAMES, F.floor(d / 5) % len(_NAMES))).alias("union_element_id"), F.when(d % 3 != 0, model).alias("source_model"),
        F.when(d % 2 == 0, pick(_SAID, F.floor(d / 2) % len(_SAID))).alias("source_element_label"), F.when(d % 4 == 3, F.col("text")).alias("source_element_definition"))


def _crosswalk(spark, sf_dir):
    return crosswalk.build(_elements(spark, sf_dir), _SCHEMA)


@query(f"WITH {_ELEMENTS} SELECT * FROM xw")
def r_crosswalk(spark, sf_dir):
    x = _crosswalk(spark, sf_dir).withColumn("secondary_fields", F.array_join("secondary_fields", ";"))
    return x.select("doc_id", "union_element_id", "information_model", "v1_field", "mapping_type", "secondary_fields", "rationale", "requires_context_review")


@query(f"WITH {_ELEMENTS} SELECT information_model AS source_model, union_element_id AS source_element, v1_field AS target_v1_field, mapping_type, requires_context_review FROM xw")
def r_crosswalk_edges(spark, sf_dir):
    return crosswalk.edges(_crosswalk(spark, sf_dir))


@query(f"WITH {_ELEMENTS} SELECT information_model, v1_field, mapping_type, count(*) AS n_source_elements FROM xw GROUP BY ALL")
def r_crosswalk_summary(spark, sf_dir):
    return crosswalk.summary(_crosswalk(spark, sf_dir))


@query(f"WITH {_ELEMENTS} SELECT v1_field, {', '.join(f'count(*) FILTER (information_model = {chr(39)}{m}{chr(39)}) AS {chr(34)}{m}{chr(34)}' for m in _MODELS)} FROM xw GROUP BY v1_field")
def r_crosswalk_matrix(spark, sf_dir):
    return crosswalk.matrix(_crosswalk(spark, sf_dir), list(_MODELS))


# A crosswalk from schemas and cards: each document is a field of one of three folds, each benchmark item a card.

_SCHEMAS = """fd AS (SELECT 'fold_0' || doc_id % 3 AS fold, 'f' || doc_id AS field_id, source AS field_name, ['core', 'extra'][doc_id % 2 + 1] AS tier, CASE WHEN doc_id % 6 = 5 THEN '' ELSE 'C' || (100 + doc_id % 150) END AS eid,
  coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' of ico' WHEN 1 THEN ' FHIR_Consent (duo)' ELSE '' END AS said FROM documents),
cd0 AS (SELECT 'fold_0' || item_id % 3 AS fold, 'C' || (100 + item_id // 2) AS card, item_id, unnest(CASE item_id % 3
  WHEN 0 THEN [{'m': 'ICO', 'e': 'E' || item_id % 9, 'l': 'a name'}, {'m': 'DUO', 'e': 'E5::x', 'l': 'E5::x'}, {'m': '', 'e': 'plain', 'l': 'plain'}]
  WHEN 1 THEN [{'m': 'ODRL', 'e': '3', 'l': '3'}, {'m': 'ICO', 'e': 'E' || item_id % 9, 'l': 'E' || item_id % 9}, {'m': 'FHIR', 'e': 'E2', 'l': 'E2'}]
  ELSE [{'m': 'DUO', 'e': 'E1', 'l': 'E1'}, {'m': 'DUO', 'e': 'E' || item_id % 9, 'l': 'E' || item_id % 9}] END) AS s FROM benchmark),
cd AS (SELECT fold, card, s.m AS source_model, s.e AS source_element, s.l AS source_label FROM cd0),
keyed AS (SELECT fold || '::' || card AS k, source_model, source_element, source_label FROM cd UNION ALL SELECT card, source_model, source_element, source_label FROM cd WHERE (card, fold) IN (SELECT (card, min(fold)) FROM cd GROUP BY card)),
pa AS (SELECT DISTINCT fold, field_id, field_name, tier, eid, source_model, source_element, source_label FROM fd JOIN keyed ON eid <> '' AND k IN (fold || '::' || eid, eid)),
re AS (SELECT fold, field_id, field_name, tier, eid, unnest(CASE WHEN len(ms) = 0 THEN [''] ELSE ms END) AS m FROM (SELECT *, list_filter(['ICO', 'DUO', 'ODRL', 'FHIR', 'FHIR_Consent'], lambda x: regexp_matches(said, '(?i)\\b' || x || '\\b')) AS ms FROM fd WHERE (fold, field_id) NOT IN (SELECT (fold, field_id) FROM pa))),
al AS (SELECT * FROM pa UNION ALL SELECT fold, field_id, field_name, tier, eid, m, CASE WHEN m = '' THEN '' ELSE 'mentioned_in_field_definition' END, CASE WHEN m = '' THEN '' ELSE 'mentioned_in_field_definition' END FROM re),
mn AS (SELECT lower(m) AS a, lower(e) AS b, string_agg(DISTINCT f, '; ' ORDER BY f) AS l FROM (SELECT ['ico', 'DUO'][item_id % 2 + 1] AS m, 'e' || item_id % 9 AS e, 'field' || item_id % 4 AS f FROM benchmark) GROUP BY ALL)"""


@query(f"""WITH {_SCHEMAS} SELECT fold, field_id, field_name, tier, eid AS evidence_card_ids, source_model, source_element, source_label, coalesce(l, '') AS manual_fields,
  CASE WHEN source_element = '' THEN 'field_without_parseable_source_elements' WHEN eid <> '' THEN 'evidence_card_source_elements' ELSE 'field_text_heuristic' END AS mapping_basis FROM al LEFT JOIN mn ON a = lower(source_model) AND b = lower(source_element)""")
def r_schema_crosswalk(spark, sf_dir):
    d, i = F.col("doc_id"), F.col("item_id")
    part = F.when(d % 4 == 0, " of ico").when(d % 4 == 1, " FHIR_Consent (duo)").otherwise("")
    fields = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("fold_0"), d % 3).alias("fold"), F.concat(F.lit("f"), d).alias("field_id"), F.col("source").alias("field_name"), F.col("text").alias("definition"), F.when(d % 2 == 0, "core").otherwise("extra").alias("tier"),
        F.when(d % 6 != 5, F.array(F.concat(F.lit("C"), 100 + d % 150))).alias("evidence_ids"), F.concat(F.coalesce("text", F.lit("")), part).alias("said"))
    e = F.concat(F.lit('"E'), i % 9, F.lit('"'))
    body = F.when(i % 3 == 0, F.concat(F.lit('{"source_elements": [{"information_model": "ICO", "element_id": '), e, F.lit(', "name": "a  name"}, "DUO::E5::x"], "elements": ["plain", "plain", " "]}')))
    body = body.when(i % 3 == 1, F.concat(F.lit('```json\n{"source_model_counts": {"ODRL": 3, "ICO": ['), e, F.lit(', {"label": ""}]}, "source_model_support": {"x": {"source_model": "FHIR", "label": "E2"}}}\n```')))
    body = body.otherwise(F.concat(F.lit('{"source_elements_by_model": {"DUO": "E1; E'), i % 9, F.lit('|E1"}}')))
    b = table(spark, sf_dir, "benchmark")
    cards = b.select(F.concat(F.lit("fold_0"), i % 3).alias("fold"), F.concat(F.lit("C"), 100 + F.floor(i / 2)).alias("card"), body.alias("body"))
    manual = b.select(F.when(i % 2 == 0, "ico").otherwise("DUO").alias("source_model"), F.concat(F.lit("e"), i % 9).alias("source_element"), F.concat(F.lit("field"), i % 4).alias("manual_field"))
    return crosswalk.from_schemas(fields, cards, manual).drop("definition")


# Reshapes


@query("SELECT doc_id, part FROM (SELECT doc_id, trim(unnest(string_split(source || ' ; ' || lang || ';;', ';'))) AS part FROM documents) WHERE part <> ''")
def m_split_rows(spark, sf_dir):
    return relational.split_rows(table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(" ; "), "lang", F.lit(";;")).alias("part")), "part").withColumn("part", F.trim("part"))


@query("WITH n AS (SELECT source, count(DISTINCT lang) AS n_members FROM documents GROUP BY source) SELECT n_members, count(*) AS n_rows FROM n GROUP BY n_members")
def m_count_distribution(spark, sf_dir):
    return relational.count_distribution(table(spark, sf_dir, "documents").select("source", "lang"), "source", "lang")


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, string_agg(lang || ':' || n, ';' ORDER BY lang) AS counts FROM c GROUP BY source")
def j_count_map(spark, sf_dir):
    m = relational.count_map(table(spark, sf_dir, "documents").select("source", "lang"), ["source"], "lang")
    return m.select("source", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";").alias("counts"))


@query("SELECT lang, n, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, lang) AS place FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def k_custom_order(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return relational.numbered(c, [relational.in_order(["fr", "de"], F.col("lang")).asc(), F.col("lang").asc()]).select("lang", "n", (F.col("number") + 1).alias("place"))


@query("SELECT event_id, 'k' AS metric, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def m_flattened(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", jsonish.flattened(F.col("props")).alias("m"))
    return e.select("event_id", F.explode("m").alias("metric", "value")).filter("metric = 'k' AND value IS NOT NULL")


@query("SELECT query_id, count(*) AS n, round(max(s), 6) AS best, round(avg(s), 6) AS mean, string_agg(DISTINCT lang, ',' ORDER BY lang) AS models FROM (SELECT doc_id % 50 AS query_id, lang, (doc_id * 37 % 100) / 100 AS s FROM documents) GROUP BY query_id")
def j_candidate_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("query_id"), "lang", ((F.col("doc_id") * 37 % 100) / 100).alias("s"))
    return d.groupBy("query_id").agg(F.count("*").alias("n"), r6(F.max("s")).alias("best"), r6(F.avg("s")).alias("mean"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("models"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS n, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS n_labels, doc_id % 4 < 2 AS parse_ok FROM documents""")
def e_forward_counts(spark, sf_dir):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, '{"annotations": [{"label": "A"}, {"field_id": "A"}]}').when(k == 1, '{"provisions": [{"actor": ["x"], "decision": {"value": "permit"}}]}').when(k == 2, "annotation,span,label\na1,some span,L1\na2,\"other, span\",L2").otherwise("")
    c = jsonish.forward_counts(raw, ["actor", "decision"])
    return table(spark, sf_dir, "documents").select("doc_id", c["n"].alias("n"), c["n_labels"].alias("n_labels"), c["parse_ok"].alias("parse_ok"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a b;c' WHEN 1 THEN 'd' ELSE '' END AS found, doc_id % 3 < 2 AS available FROM documents""")
def e_unmatched_language(spark, sf_dir):
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, '{"x": [{"unmatched_language": ["a b", {"why": "c"}, "a b"]}]}').when(k == 1, '{"Not Covered": "d", "other": "z"}').otherwise('{"other": ["z"]}')
    u = diagnostics.unmatched_language(table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")), "raw")
    return u.select("doc_id", F.array_join("unmatched_language", ";").alias("found"), F.col("unmatched_available").alias("available"))


@query("""SELECT doc_id, unnest(['decision', 'actor', 'actor']) AS role, unnest(['permit', 'one ' || doc_id % 3, 'two']) AS span, 'p' || doc_id % 5 AS provision_id FROM documents""")
def e_provisions(spark, sf_dir):
    d = F.col("doc_id")
    raw = F.concat(F.lit('{"provisions": [{"provision_id": "p'), d % 5, F.lit('", "decision": {"evidence_span_text": "permit"}, "actor": [{"evidence_span_text": "one '), d % 3, F.lit('"}, "two"], "provenance": "none"}]}'))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(jsonish.provisions(raw)))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'permit;x y' ELSE 'one;two three' END AS spans, CASE doc_id % 3 WHEN 2 THEN 'decision;actor' ELSE 'A;B' END AS labels FROM documents""")
def r_annotation_items(spark, sf_dir):
    k = F.col("doc_id") % 3
    listed = '[{"span_text": "one", "label": "A"}, {"span": " two  three ", "field_name": "B"}]'
    raw = F.when(k == 0, '{"annotations": ' + listed + "}").when(k == 1, "```json\n" + listed + "\n```").otherwise('{"provisions": [{"decision": {"value": "permit"}, "actor": ["x y"]}]}')
    i = diagnostics.annotation_items(raw)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(i["spans"], ";").alias("spans"), F.array_join(i["labels"], ";").alias("labels"))
