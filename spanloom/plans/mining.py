"""Registered queries of the mining path: identifiers, mentions, pairs of senses, evidence, packets; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import spans, text
from spanloom.operators import evidence, mentions, packets, pairs, relational, resolve
from spanloom.plans import fixtures as fx
from spanloom.plans.catalog import query, r6
from spanloom.session import spread, table


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


# Identifiers as a model may return them: ten ways, right and wrong

_GIVEN = """given AS (SELECT doc_id, (pos - 1) // 3 AS ann_idx, span, CASE (doc_id + pos) % 10
    WHEN 0 THEN label WHEN 1 THEN label WHEN 2 THEN split_part(label, '::', 2) WHEN 3 THEN replace(label, '::', ':') WHEN 4 THEN lower(replace(label, '::', ' ')) WHEN 5 THEN lower(replace(label, '::', ' '))
    WHEN 6 THEN 'unmatched_language' WHEN 7 THEN ' ' WHEN 8 THEN NULL ELSE upper(information_model) || '::zzz' END AS given_id,
  CASE (doc_id + pos) % 10 WHEN 0 THEN '' WHEN 1 THEN 'words of 99 letters' WHEN 4 THEN '' WHEN 8 THEN '' ELSE 'Words  of ' || length(span) || ' letters' END AS given_label FROM spans)"""


def _given(spark, sf_dir):
    s = fx.spans(spark, sf_dir)
    k = (F.col("doc_id") + 3 * F.col("ann_idx") + 1) % 10
    label = F.col("label")
    spelt = F.lower(F.replace(label, F.lit("::"), F.lit(" ")))
    given = (
        F.when(k < 2, label).when(k == 2, text.after_first(label)).when(k == 3, F.replace(label, F.lit("::"), F.lit(":"))).when(k.isin(4, 5), spelt).when(k == 6, "unmatched_language").when(k == 7, " ")
        .when(k == 8, None).otherwise(F.concat(F.upper("information_model"), F.lit("::zzz")))
    )
    named = F.when(k.isin(0, 4, 8), "").when(k == 1, "words of 99 letters").otherwise(F.concat(F.lit("Words  of "), F.length("span"), F.lit(" letters")))
    return s.select("doc_id", "ann_idx", "span", "original_text", "information_model", "llm", given.alias("given_id"), named.alias("given_label"))


_ID_KEY = "array_to_string(list_transform(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda p: p <> ''), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN CAST(CAST(p AS BIGINT) AS VARCHAR) ELSE p END), '|')"
_NL = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
# the text of the rules: exact, unique source id, model and source id, one normalized spelling (with its label), one label
_RESOLVED = f"""{_GIVEN}, li AS (SELECT *, lower(source_element_label) AS l FROM inv),
spell AS (SELECT DISTINCT union_element_id AS u, l, {_ID_KEY.format(x="k")} AS k FROM (SELECT union_element_id, l, unnest([union_element_id, source_element_id, source_element_label, source_model || '::' || source_element_id]) AS k FROM li)),
asked AS (SELECT DISTINCT trim(given_id) AS uid, {_NL.format(x="given_label")} AS lab FROM given),
f AS (SELECT uid, lab, split_part(uid, '::', 1) AS hint,
  (SELECT l FROM li WHERE union_element_id = uid) AS exact_label, (SELECT count(*) FROM li WHERE source_element_id = uid) AS n_source, (SELECT min(l) FROM li WHERE source_element_id = uid) AS source_label,
  (SELECT min(union_element_id) FROM li WHERE source_element_id = uid) AS source_found,
  (SELECT min(union_element_id) FROM li WHERE position('::' IN uid) = 0 AND source_model || ':' || source_element_id = uid) AS pair_found, (SELECT min(l) FROM li WHERE position('::' IN uid) = 0 AND source_model || ':' || source_element_id = uid) AS pair_label,
  (SELECT count(DISTINCT u) FROM spell WHERE k = {_ID_KEY.format(x="uid")}) AS n_norm, (SELECT min(u) FROM spell WHERE k = {_ID_KEY.format(x="uid")}) AS norm_found, (SELECT min(l) FROM spell WHERE k = {_ID_KEY.format(x="uid")}) AS norm_label,
  (SELECT count(*) FROM li WHERE l = lab AND lower(source_model) = lower(split_part(uid, '::', 1)) AND contains(uid, '::')) AS n_ml, (SELECT min(union_element_id) FROM li WHERE l = lab AND lower(source_model) = lower(split_part(uid, '::', 1)) AND contains(uid, '::')) AS ml_found,
  (SELECT count(*) FROM li WHERE l = lab) AS n_l, (SELECT min(union_element_id) FROM li WHERE l = lab) AS l_found FROM asked),
c AS (SELECT *, CASE WHEN uid IS NULL THEN 'not_string' WHEN uid = '' THEN 'empty' WHEN lower(uid) IN {_in(resolve.RESERVED)} THEN 'reserved_non_label_id'
   WHEN exact_label IS NOT NULL AND lab <> '' AND lab <> exact_label THEN 'label_mismatch_for_exact_union_id' WHEN exact_label IS NOT NULL THEN CASE WHEN lab <> '' THEN 'exact_union_id_label_match' ELSE 'exact_union_id_no_label_returned' END
   WHEN n_source = 1 AND (lab = '' OR lab = source_label) THEN CASE WHEN lab <> '' THEN 'exact_source_element_id_label_match' ELSE 'exact_source_element_id_no_label_returned' END
   WHEN pair_found IS NOT NULL AND (lab = '' OR lab = pair_label) THEN CASE WHEN lab <> '' THEN 'source_model_pair_label_match' ELSE 'source_model_pair_no_label_returned' END
   WHEN n_norm = 1 AND lab <> '' AND lab = norm_label THEN 'normalized_id_and_label_match' WHEN n_norm = 1 AND lab = '' THEN 'normalized_id_match_requires_label' WHEN n_norm > 1 THEN 'ambiguous_normalized_id_match'
   WHEN lab <> '' AND (n_ml = 1 OR n_l = 1) THEN 'unique_source_element_label_match' ELSE 'no_inventory_match' END AS reason FROM f),
known AS (SELECT uid, lab, reason, CASE WHEN reason LIKE 'exact_union_id%' THEN 'valid' WHEN reason = 'reserved_non_label_id' THEN 'routed_to_unmatched' WHEN reason LIKE '%_match' AND reason NOT LIKE 'ambiguous%' AND reason <> 'no_inventory_match' OR reason LIKE 'exact_source%' OR reason LIKE 'source_model_pair%' THEN 'repaired' ELSE 'invalid' END AS status,
  CASE WHEN reason LIKE 'exact_source%' THEN source_found WHEN reason LIKE 'source_model_pair%' THEN pair_found WHEN reason = 'normalized_id_and_label_match' THEN norm_found WHEN reason = 'unique_source_element_label_match' THEN CASE WHEN n_ml = 1 THEN ml_found ELSE l_found END ELSE uid END AS resolved_id FROM c),
resolved AS (SELECT g.*, k.reason, k.status, k.resolved_id FROM given g JOIN known k ON trim(g.given_id) IS NOT DISTINCT FROM k.uid AND {_NL.format(x="g.given_label")} = k.lab)"""
_R = f"WITH {fx.RT}, {fx.ANN}, {fx.INV}, {_RESOLVED} "


@query(_R + "SELECT doc_id, ann_idx, given_id, resolved_id, status, reason FROM resolved")
def h_resolve(spark, sf_dir):
    return resolve.resolve(_given(spark, sf_dir), fx.inventory(spark, sf_dir)).select("doc_id", "ann_idx", "given_id", "resolved_id", "status", "reason")


@query(_R + """SELECT doc_id, ann_idx, given_id, CASE WHEN uid IS NULL OR uid = '' THEN 'invalid' WHEN exact_label IS NOT NULL THEN 'valid' WHEN n_source = 1 OR pair_found IS NOT NULL THEN 'repairable' ELSE 'invalid' END AS status,
  CASE WHEN exact_label IS NULL AND n_source = 1 THEN source_found WHEN exact_label IS NULL AND pair_found IS NOT NULL THEN pair_found ELSE uid END AS resolved_id FROM given JOIN (SELECT DISTINCT uid, exact_label, n_source, source_found, pair_found FROM f) ON trim(given_id) IS NOT DISTINCT FROM uid""")
def h_repairable(spark, sf_dir):
    return resolve.repairable(_given(spark, sf_dir), fx.inventory(spark, sf_dir)).select("doc_id", "ann_idx", "given_id", "status", "resolved_id")


@query(_R + f"""SELECT doc_id, count(*) AS n_annotations_raw, count(*) FILTER (status = 'valid') AS n_valid, count(*) FILTER (status = 'repaired') AS n_repaired, count(*) FILTER (status = 'invalid') AS n_invalid, count(*) FILTER (status = 'routed_to_unmatched') AS n_routed,
  coalesce(string_agg(resolved_id, ';' ORDER BY ann_idx) FILTER (status IN ('valid', 'repaired')), '') AS ids, count(DISTINCT lower(span)) FILTER (status = 'routed_to_unmatched' AND span <> '') AS n_unmatched FROM resolved GROUP BY doc_id""")
def h_validated(spark, sf_dir):
    v = resolve.validated(_given(spark, sf_dir), fx.inventory(spark, sf_dir), ["doc_id"])
    return v.select("doc_id", "n_annotations_raw", "n_valid", "n_repaired", "n_invalid", "n_routed", F.array_join("annotations.id", ";").alias("ids"), F.size("unmatched_language").cast("long").alias("n_unmatched"))


@query(_R + "SELECT DISTINCT doc_id, lower(span) AS span, reason FROM resolved WHERE status = 'routed_to_unmatched' AND span <> ''")
def u_unmatched_items(spark, sf_dir):
    v = resolve.validated(_given(spark, sf_dir), fx.inventory(spark, sf_dir), ["doc_id"])
    return v.select("doc_id", F.explode("unmatched_items").alias("i")).select("doc_id", F.lower("i.span").alias("span"), "i.reason")


@query(_R + "SELECT doc_id, ann_idx, span, status, reason, CASE WHEN status = 'repaired' THEN resolved_id ELSE '' END AS resolved_id FROM resolved WHERE status <> 'valid'")
def h_invalid_audit(spark, sf_dir):
    return resolve.invalid_audit(_given(spark, sf_dir), fx.inventory(spark, sf_dir)).select("doc_id", "ann_idx", "span", "status", "reason", "resolved_id")


@query(_R + """, s AS (SELECT CASE WHEN uid IS NULL OR uid = '' THEN 'invalid' WHEN exact_label IS NOT NULL THEN 'valid' WHEN n_source = 1 OR pair_found IS NOT NULL THEN 'repairable' ELSE 'invalid' END AS st FROM given JOIN (SELECT DISTINCT uid, exact_label, n_source, pair_found FROM f) ON trim(given_id) IS NOT DISTINCT FROM uid),
  o AS (SELECT count(*) AS n_annotations_total, count(*) FILTER (st = 'repairable') AS n_repairable, count(*) FILTER (st = 'invalid') AS n_invalid_primary, (SELECT count(*) FROM resolved WHERE status = 'invalid') AS q, (SELECT count(*) FROM rt) AS n FROM s)
SELECT n_annotations_total, n_repairable, n_invalid_primary, q AS n_invalid_quarantined, n_repairable + n_invalid_primary + q AS n_problem_total, round(q / greatest(1, n_annotations_total), 6) AS quarantine_rate, n > 0 AND n_repairable + n_invalid_primary + q = 0 AS ready_strict, n > 0 AND n_repairable + n_invalid_primary = 0 AND q / greatest(1, n_annotations_total) <= 0.05 AS ready_pragmatic FROM o""")
def h_readiness(spark, sf_dir):
    g, inv = _given(spark, sf_dir), fx.inventory(spark, sf_dir)
    runs = fx.roundtrips(spark, sf_dir).select("doc_id", F.lit(True).alias("parse_ok"), F.lit(True).alias("has_interpretation"))
    r = resolve.readiness(g, resolve.resolve(g, inv).filter("status = 'invalid'"), runs, runs, runs.filter("doc_id < 0"), inv)
    return r.select("n_annotations_total", "n_repairable", "n_invalid_primary", "n_invalid_quarantined", "n_problem_total", r6("quarantine_rate").alias("quarantine_rate"), "ready_strict", "ready_pragmatic")


@query(f"""WITH {fx.RT}, {fx.ANN}, {fx.INV}, a AS (SELECT doc_id, (pos - 1) // 3 AS ann_idx, information_model, CASE pos WHEN 1 THEN 'e' || length(span) WHEN 4 THEN 'words of ' || length(span) || ' letters' ELSE 'no such' END AS name FROM spans)
SELECT doc_id, ann_idx, name, i.union_element_id AS found_id, CASE WHEN i.union_element_id IS NULL THEN 'invalid' ELSE 'valid' END AS status FROM a LEFT JOIN inv i ON lower(i.source_model) = information_model AND name IN (lower(i.source_element_id), i.source_element_label)
WHERE i.union_element_id IS NOT NULL OR name NOT IN (SELECT source_element_label FROM inv)""")
def h_by_alias(spark, sf_dir):
    k, n = F.col("ann_idx"), F.length("span")
    name = F.when(k == 0, F.concat(F.lit("e"), n)).when(k == 1, F.concat(F.lit("words of "), n, F.lit(" letters"))).otherwise("no such")
    return resolve.by_alias(fx.spans(spark, sf_dir).select("doc_id", "ann_idx", "information_model", name.alias("name")), fx.inventory(spark, sf_dir), "information_model", "name").select("doc_id", "ann_idx", "name", "found_id", "status")


_VALUES = ["Permit", "prohibited", "a long rationale of many words that explains", "MUST", "both"]


@query(f"""WITH i AS (SELECT unnest(['ODRL::Rule_TestSentence', 'DUO::DUO.decision', 'EN::E5']) AS u, unnest(['Rule_TestSentence', 'DUO decision', 'words of 5 letters']) AS l),
e AS (SELECT doc_id, (['ODRL::Rule_TestSentence', 'DUO::DUO.decision', 'EN::E5', '', 'XX::none'])[doc_id % 5 + 1] AS given_id, ({_VALUES})[doc_id // 5 % 5 + 1] AS value, doc_id % 7 AS n FROM documents),
v AS (SELECT *, CASE value WHEN 'Permit' THEN 'permit' WHEN 'prohibited' THEN 'deny' WHEN 'MUST' THEN 'obligation' WHEN 'both' THEN 'mixed' ELSE '' END AS canonical_value FROM e)
SELECT doc_id, canonical_value, CASE WHEN n < 1 THEN 'no_valid_span_annotations' WHEN given_id = '' THEN 'missing_union_element_id' WHEN canonical_value = '' THEN 'non_controlled_or_explanatory_value' WHEN given_id = 'XX::none' THEN 'invalid_sentence_level_id:no_inventory_match' WHEN given_id = 'EN::E5' THEN 'not_approved_sentence_decision_field' ELSE 'included' END AS outcome FROM v""")
def h_sentence_level(spark, sf_dir):
    inv = spark.sql("SELECT * FROM VALUES ('ODRL::Rule_TestSentence', 'ODRL', 'Rule_TestSentence', 'Rule_TestSentence'), ('DUO::DUO.decision', 'DUO', 'DUO.decision', 'DUO decision'), ('EN::E5', 'EN', 'E5', 'words of 5 letters') AS t(union_element_id, source_model, source_element_id, source_element_label)")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    d = F.col("doc_id")
    e = table(spark, sf_dir, "documents").select("doc_id", pick(["ODRL::Rule_TestSentence", "DUO::DUO.decision", "EN::E5", "", "XX::none"], d % 5).alias("given_id"), F.lit("").alias("given_label"), pick(_VALUES, F.floor(d / 5) % 5).alias("value"), (d % 7).alias("n_valid_spans"))
    return resolve.sentence_level(e, inv).select("doc_id", "canonical_value", "outcome")


@query("""WITH f AS (SELECT DISTINCT source || '.txt' AS form FROM documents), k AS (SELECT DISTINCT CASE WHEN length(source) % 2 = 0 THEN source || '.txt' ELSE upper(source) || ' TXT' END AS form_key, 'fold_0' || length(source) % 3 AS fold_id FROM documents WHERE length(source) <> 3)
SELECT form, coalesce(e.fold_id, l.fold_id) AS fold_id, CASE WHEN e.fold_id IS NOT NULL THEN 'exact' WHEN l.fold_id IS NOT NULL THEN 'unique_loose' ELSE 'unmatched' END AS match_type FROM f LEFT JOIN k e ON e.form_key = form LEFT JOIN k l ON trim(regexp_replace(lower(l.form_key), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(form), '[^a-z0-9]+', ' ', 'g'))""")
def h_fold_matches(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("source").distinct()
    n = F.length("source")
    folds = s.filter(n != 3).select(F.when(n % 2 == 0, F.concat("source", F.lit(".txt"))).otherwise(F.concat(F.upper("source"), F.lit(" TXT"))).alias("form_key"), F.concat(F.lit("fold_0"), n % 3).alias("fold_id"))
    return resolve.fold_matches(s.select(F.concat("source", F.lit(".txt")).alias("form")), folds)


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'own' END, 'lang ' || lang) AS label FROM documents")
def h_fill_blank(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, "own").otherwise(" ").alias("label"))
    langs = d.select("lang").distinct().select(F.upper("lang").alias("key"), F.concat(F.lit("lang "), "lang").alias("label"), F.lit(1).alias("at"))
    return resolve.fill_blank(d, langs, [F.lit("nothing"), F.upper("lang")], "key", ["label"], "at").select("doc_id", "label")


# Mentions


@query(f"""WITH {fx.RT}, {fx.ANN}, s AS (SELECT doc_id, (pos - 1) // 3 AS ann_idx, span, original_text, CASE WHEN span = '' THEN -1 ELSE strpos(original_text, span) - 1 END AS st FROM spans)
SELECT doc_id, ann_idx, st AS "at", CASE WHEN st < 0 THEN '' ELSE substr(original_text, greatest(st - 100, 0) + 1, least(st, 100)) END || ' || ' || CASE WHEN st < 0 THEN '' ELSE substr(original_text, st + length(span) + 1, 100) END AS context,
  CASE WHEN span = '' OR len(string_split(original_text, span)) < 2 THEN -1 WHEN len(string_split(original_text, span)) = 2 THEN st ELSE length(string_split(original_text, span)[1]) + length(string_split(original_text, span)[2]) + length(span) END AS second FROM s""")
def g_span_context(spark, sf_dir):
    s = fx.spans(spark, sf_dir).withColumn("at", F.when(F.col("span") == "", -1).otherwise(spans.located(F.col("original_text"), F.col("span"))))
    t, span, at = F.col("original_text"), F.col("span"), F.col("at")
    end = F.when(at < 0, -1).otherwise(at + F.length(span))
    return s.select("doc_id", "ann_idx", "at", spans.context(t, at, end).alias("context"), spans.nth_start(t, span, F.lit(1)).alias("second"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9'']+') AS m, regexp_split_to_array(coalesce(text, ''), '[A-Za-z0-9'']+') AS b FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, length(unnest(m)) AS m, length(unnest(b[1:len(m)])) AS b FROM w), v AS (SELECT doc_id, i, sum(b + m) OVER (PARTITION BY doc_id ORDER BY i) - m AS st FROM u)
SELECT documents.doc_id, count(i) AS n, coalesce(sum(i * st), 0)::BIGINT AS weighted_starts FROM documents LEFT JOIN v USING (doc_id) GROUP BY documents.doc_id""")
def g_token_offsets(spark, sf_dir):
    o = spread(table(spark, sf_dir, "documents")).select("doc_id", spans.token_offsets(F.col("text"), "[A-Za-z0-9']+").alias("o"))
    weighted = F.aggregate(F.transform("o", lambda x, i: (i + 1).cast("long") * x["start"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return o.select("doc_id", F.size("o").cast("long").alias("n"), weighted.alias("weighted_starts"))


def _annotated(spark, sf_dir):
    """Round trips whose answers are JSON of several shapes, bracketed text or no annotation at all."""
    rt = fx.roundtrips(spark, sf_dir)
    w = lambda i: F.coalesce(F.try_element_at("tk", F.lit(i + 1)), F.lit("x"))
    d = F.col("doc_id")
    bad = F.when(d % 7 == 0, "unmatched_language").when(d % 7 == 1, "DUO.decision").when(d % 7 == 2, "").otherwise(F.concat(F.lit("E"), F.length(w(4))))
    first = F.struct(w(1).alias("span_text"), F.concat(F.lit("E"), F.length(w(1))).alias("label_name"), F.lit("Permit").alias("decision"))
    second = F.struct(w(4).alias("evidence_span_text"), F.when(d % 7 == 1, "DUO::DUO.decision").otherwise(bad).alias("label"), F.lit("deny").alias("decision_value"))
    third = F.struct(w(1).alias("span"), F.lit("E0").alias("source_element_id"))
    listed = F.concat(F.lit("["), F.to_json(first), F.lit(","), F.to_json(second), F.lit(","), F.to_json(third), F.lit("]"))
    compact = F.concat(w(1), F.lit(" [E1] (permit) "), w(4), F.lit(" [NA] ()"))
    raw = F.when(d % 4 == 0, listed).when(d % 4 == 1, F.concat(F.lit('{"annotations": '), listed, F.lit("}"))).when(d % 4 == 2, compact).otherwise("N/A")
    return rt.select("doc_id", "information_model", "llm", "form_id", "meaning_preserved", "original_text", w(1).alias("w1"), w(4).alias("w4"), raw.alias("raw"))


_ANNOTATED = f"""{fx.RT}, r AS (SELECT doc_id, information_model, meaning_preserved, original_text, coalesce(tk[2], 'x') AS w1, coalesce(tk[5], 'x') AS w4, doc_id % 4 AS shape, doc_id % 7 AS k FROM rt),
x AS (SELECT doc_id, meaning_preserved, original_text, information_model, shape, unnest(CASE WHEN shape < 2 THEN [1, 2, 3] WHEN shape = 2 THEN [1, 2] ELSE [1] END) AS ann_idx, w1, w4, k FROM r),
y AS (SELECT doc_id, meaning_preserved, original_text, ann_idx, CASE WHEN shape = 3 THEN 'N/A' WHEN shape < 2 AND ann_idx = 2 OR shape = 2 AND ann_idx = 2 THEN w4 ELSE w1 END AS span,
  CASE WHEN shape = 3 THEN 'N/A' WHEN shape = 2 THEN CASE ann_idx WHEN 1 THEN 'E1' ELSE 'NA' END WHEN ann_idx = 1 THEN 'E' || length(w1) WHEN ann_idx = 3 THEN 'E0' ELSE CASE k WHEN 0 THEN 'unmatched_language' WHEN 1 THEN 'DUO::DUO.decision' WHEN 2 THEN '' ELSE 'E' || length(w4) END END AS key FROM x),
z AS (SELECT *, CASE WHEN lower(span) IN ('na', 'n/a', 'none', 'null', 'unknown') AND lower(key) IN ('', 'na', 'n/a', 'none', 'null', 'unknown') THEN 'na_only' WHEN span = '' OR key = '' THEN 'empty_span_or_label' WHEN key = 'unmatched_language' THEN 'reserved_non_annotation_content' WHEN key = 'DUO::DUO.decision' THEN 'sentence_level_label' ELSE '' END AS reason FROM y)"""


@query(f"WITH {_ANNOTATED} SELECT doc_id, ann_idx, span, key, reason FROM z")
def u_annotation_reasons(spark, sf_dir):
    return mentions.annotations(_annotated(spark, sf_dir), "raw", "information_model").select("doc_id", F.col("ann_idx").cast("long").alias("ann_idx"), "span", "key", "reason")


@query(f"""WITH {_ANNOTATED}, g AS (SELECT doc_id, max(meaning_preserved) AS y, count(*) FILTER (reason = '') AS good, count(*) FILTER (reason = 'na_only') AS na, count(*) AS n FROM z GROUP BY doc_id)
SELECT doc_id, reason, row_level, count(*) AS n FROM (SELECT doc_id, reason, false AS row_level FROM z WHERE reason <> '' UNION ALL SELECT doc_id, CASE WHEN na = n THEN 'positive_preserved_but_solely_na_llm_tags' ELSE 'positive_preserved_but_no_valid_span_annotations' END, true FROM g WHERE y = 1 AND good = 0) GROUP BY ALL""")
def u_mention_audit(spark, sf_dir):
    rows = _annotated(spark, sf_dir)
    a = mentions.audit(rows, mentions.annotations(rows, "raw", "information_model"), "doc_id", "meaning_preserved")
    return a.groupBy("doc_id", "reason", "row_level").agg(F.count("*").alias("n"))


_TERMS = f"list_filter(regexp_extract_all(lower({{x}}), '[a-z][a-z0-9_-]*'), lambda t: t NOT IN {_in((*text.MENTION_STOP, *text.DECISION_ARTIFACTS))})"


@query(f"""WITH {_ANNOTATED}, u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(span) ORDER BY ann_idx) - 1 AS occ, string_split(original_text, span) AS parts FROM z WHERE reason = ''),
v AS (SELECT *, CASE WHEN len(parts) < 2 THEN -1 ELSE list_sum(list_transform(parts[1:least(occ, len(parts) - 2) + 1], lambda p: length(p))) + least(occ, len(parts) - 2) * length(span) END AS span_start FROM u)
SELECT doc_id, ann_idx, span, span_start::BIGINT AS span_start, CASE WHEN span_start < 0 THEN -1 ELSE span_start + length(span) END::BIGINT AS span_end, array_to_string({_TERMS.format(x="span")}, ' ') AS span_canonical,
  CASE meaning_preserved WHEN 1 THEN 'valid_positive' WHEN 0 THEN 'invalid_negative' ELSE 'unlabeled' END AS validity FROM v""")
def u_mentions(spark, sf_dir):
    m = mentions.mentions(mentions.annotations(_annotated(spark, sf_dir), "raw", "information_model"), "doc_id", "original_text", "meaning_preserved")
    return m.select("doc_id", F.col("ann_idx").cast("long").alias("ann_idx"), "span", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"), "span_canonical", "validity")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'F' || doc_id WHEN source <> '' THEN source ELSE '' END AS form, CASE WHEN doc_id % 2 = 0 THEN 'S' || doc_id ELSE 'SENT_' || substr(sha1(trim(regexp_replace(coalesce(text, ''), '[\\t-\\r\\x{85}\\p{Z}]+', ' ', 'g'))), 1, 12) END AS sentence_key, 'ROW_' || (doc_id + 2) AS roundtrip_key FROM documents""")
def u_identities(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    d = d.withColumns({"form_key": F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("F"), "doc_id", F.lit("_annotated.csv"))), "sentence_id": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" S"), "doc_id"))})
    return mentions.identities(d, ["form_key", "source"], ["sentence_id"], ["roundtrip_id"], "text", "doc_id").select("doc_id", "form", "sentence_key", "roundtrip_key")


_M = """mention AS (SELECT 'c' || doc_id // 3 AS context_id, label AS sense, span, (doc_id * 7 + (pos - 1) // 3 * 11) % 20 AS span_start, (doc_id * 7 + (pos - 1) // 3 * 11) % 20 + 3 + doc_id % 4 AS span_end,
  ((doc_id * 7 + (pos - 1) // 3 * 11) % 20) // 4 AS token_start, ((doc_id * 7 + (pos - 1) // 3 * 11) % 20 + 3 + doc_id % 4) // 4 AS token_end, information_model, llm, form_id AS form,
  CASE doc_id % 5 WHEN 0 THEN 'invalid_negative' WHEN 1 THEN 'unlabeled' ELSE 'valid_positive' END AS validity, doc_id * 10 + (pos - 1) // 3 AS provenance FROM spans)"""


def _mentions(spark, sf_dir):
    d, k = F.col("doc_id"), F.col("ann_idx")
    at = (d * 7 + k * 11) % 20
    end = at + 3 + d % 4
    validity = F.when(d % 5 == 0, "invalid_negative").when(d % 5 == 1, "unlabeled").otherwise("valid_positive")
    return fx.spans(spark, sf_dir).select(
        F.concat(F.lit("c"), F.floor(d / 3)).alias("context_id"), F.col("label").alias("sense"), "span", at.alias("span_start"), end.alias("span_end"), F.floor(at / 4).alias("token_start"), F.floor(end / 4).alias("token_end"),
        "information_model", "llm", F.col("form_id").alias("form"), validity.alias("validity"), (d * 10 + k).alias("provenance"), F.lit("").alias("role_signature"), F.lit("").alias("local_context"),
    )


_POS = "FILTER (both_pos)"
_PAIR_SQL = f"""{fx.RT}, {fx.ANN}, {_M}, m AS (SELECT *, list_distinct({_TERMS.format(x="span")}) AS t FROM mention QUALIFY row_number() OVER (PARTITION BY context_id, sense, span_start, span_end, information_model, llm, validity ORDER BY provenance) = 1),
pp AS (SELECT a.sense AS sense_1, b.sense AS sense_2, a.context_id, a.form, a.information_model AS ma, b.information_model AS mb, a.llm AS la, b.llm AS lb, a.validity = 'valid_positive' AND b.validity = 'valid_positive' AS both_pos, a.validity = 'invalid_negative' OR b.validity = 'invalid_negative' AS neg,
  a.span_start = b.span_start AND a.span_end = b.span_end AS same, greatest(a.span_start, b.span_start) < least(a.span_end, b.span_end) AS over, (a.span_start <= b.span_start AND a.span_end >= b.span_end) OR (b.span_start <= a.span_start AND b.span_end >= a.span_end) AS inside,
  CASE WHEN a.token_end < b.token_start THEN b.token_start - a.token_end - 1 WHEN b.token_end < a.token_start THEN a.token_start - b.token_end - 1 ELSE 0 END AS gap,
  CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END AS alike FROM m a JOIN m b ON a.context_id = b.context_id AND a.sense < b.sense),
pos AS (SELECT sense, count(DISTINCT context_id) AS n FROM mention WHERE validity = 'valid_positive' GROUP BY sense), tot AS (SELECT greatest(1, count(DISTINCT context_id)) AS n FROM mention WHERE validity = 'valid_positive'),
g AS (SELECT sense_1, sense_2, count(*) FILTER (both_pos AND same) AS same_span_count, count(*) FILTER (both_pos AND over) AS overlap_count, count(*) FILTER (both_pos AND over AND inside AND NOT same) AS nested_span_count, count(*) {_POS} AS same_sentence_cooccurrence,
  count(*) FILTER (both_pos AND ma = mb) AS within_information_model_cooccurrence, count(*) FILTER (both_pos AND la <> lb) AS cross_llm_cooccurrence, count(*) FILTER (both_pos AND ma <> mb AND la = lb) AS cross_model_same_llm, count(*) FILTER (neg) AS negative_failure_support,
  round(coalesce(sum(1 / (1 + gap)) {_POS}, 0), 6) AS proximity_weighted_cooccurrence, round(avg(gap) {_POS}, 6) AS mean_token_distance, round(coalesce(avg(alike) {_POS}, 0), 6) AS span_text_similarity, count(DISTINCT form) {_POS} AS form_support, count(DISTINCT context_id) {_POS} AS sentence_support,
  len(list_distinct(list_concat(coalesce(list(ma) {_POS}, []), coalesce(list(mb) {_POS}, [])))) AS cross_model_support, len(list_distinct(list_concat(coalesce(list(la) {_POS}, []), coalesce(list(lb) {_POS}, [])))) AS cross_llm_support FROM pp GROUP BY ALL),
lifted AS (SELECT g.*, coalesce(same_sentence_cooccurrence * tot.n / nullif(p1.n * p2.n, 0), 0) AS l FROM g LEFT JOIN pos p1 ON p1.sense = sense_1 LEFT JOIN pos p2 ON p2.sense = sense_2, tot)"""
_PAIR_COLUMNS = ["sense_1", "sense_2", "same_span_count", "overlap_count", "nested_span_count", "same_sentence_cooccurrence", "within_information_model_cooccurrence", "cross_llm_cooccurrence", "cross_model_same_llm", "negative_failure_support", "proximity_weighted_cooccurrence", "span_text_similarity", "form_support", "sentence_support", "cross_model_support", "cross_llm_support"]


@query(f"WITH {_PAIR_SQL} SELECT {', '.join(_PAIR_COLUMNS)}, mean_token_distance, round(l, 6) AS lift, round(CASE WHEN l > 0 THEN log2(l) ELSE 0 END, 6) AS pmi FROM lifted")
def n_pair_features(spark, sf_dir):
    f = pairs.pair_features(_mentions(spark, sf_dir))
    counts = [c for c in ("cross_model_support", "cross_llm_support")]
    return f.select(*(F.col(c).cast("long").alias(c) if c in counts else c for c in _PAIR_COLUMNS), r6("mean_token_distance").alias("mean_token_distance"), "lift", "pmi")


_NODE = "node AS (SELECT DISTINCT label AS sense, CASE length(label) % 3 WHEN 0 THEN 'action' WHEN 1 THEN 'resource' ELSE 'other' END AS role, CASE WHEN label LIKE '%E1%' THEN 1.5 ELSE 0.2 END AS entropy, CASE WHEN length(label) % 2 = 0 THEN 1.0 ELSE 0.8 END AS e FROM spans)"


def _nodes(spark, sf_dir):
    n, s = F.length("sense"), F.col("sense")
    m = _mentions(spark, sf_dir).select("sense").distinct()
    role = F.when(n % 3 == 0, "action").when(n % 3 == 1, "resource").otherwise("other")
    return m.select("sense", role.alias("role"), F.when(F.contains(s, F.lit("E1")), 1.5).otherwise(0.2).alias("entropy"), F.array(F.when(n % 2 == 0, 1.0).otherwise(0.8)).alias("embedding"))


_T = pairs.THRESHOLDS
_TYPED_SQL = f"""{_PAIR_SQL}, {_NODE}, w AS (SELECT lifted.*, round(a.e * b.e, 6) AS emb, a.role = b.role AND a.role <> 'other' AS ok, a.role <> b.role AND a.role <> 'other' AND b.role <> 'other' AS clash, greatest(a.entropy, b.entropy) >= {_T["unsafe_entropy"]} AS high,
   negative_failure_support / greatest(1, same_sentence_cooccurrence + negative_failure_support) AS ratio, form_support >= 1 AND sentence_support >= 1 AND same_sentence_cooccurrence >= 2 AS rec, (cross_model_support > 1 OR cross_llm_support > 1)::INT AS x FROM lifted JOIN node a ON a.sense = sense_1 JOIN node b ON b.sense = sense_2),
ty AS (SELECT *, CASE WHEN clash AND (same_span_count > 0 OR overlap_count > 0 OR emb >= 0.68) THEN 'unsafe_to_merge' WHEN high AND emb >= 0.68 AND NOT ok THEN 'unsafe_to_merge' WHEN rec AND ratio <= 0.5 AND ok AND same_span_count >= 2 AND emb >= 0.72 THEN 'near_equivalent'
   WHEN rec AND ratio <= 0.5 AND ok AND overlap_count >= 2 AND span_text_similarity >= 0.7 THEN 'near_equivalent' WHEN nested_span_count >= 2 AND rec THEN 'broader_narrower' WHEN same_sentence_cooccurrence >= 2 AND proximity_weighted_cooccurrence >= 0.75 AND overlap_count = 0 AND clash THEN 'complementary' ELSE 'related_context_only' END AS relationship_type FROM w),
tc AS (SELECT *, round(CASE relationship_type WHEN 'near_equivalent' THEN least(1.0, 0.20 * same_span_count + 0.15 * overlap_count + 0.22 * emb + 0.18 * span_text_similarity + 0.08 * x + 0.05 * ln(1 + form_support) + 0.05 * ln(1 + sentence_support) - 0.15 * ratio)
   WHEN 'broader_narrower' THEN least(1.0, nested_span_count / greatest(1, same_sentence_cooccurrence) + 0.20 * span_text_similarity + 0.05 * ln(1 + form_support)) WHEN 'complementary' THEN least(1.0, proximity_weighted_cooccurrence / greatest(1, same_sentence_cooccurrence) + 0.1 * ln(1 + same_sentence_cooccurrence) + 0.05)
   WHEN 'unsafe_to_merge' THEN least(1.0, 0.5 + 0.25 * emb + 0.1 * ln(1 + overlap_count + same_span_count) + 0.1 * high::INT) ELSE 0 END, 6) AS relationship_confidence FROM ty)"""


def _typed(spark, sf_dir):
    return pairs.typed(pairs.with_nodes(pairs.pair_features(_mentions(spark, sf_dir)), _nodes(spark, sf_dir)))


@query(f"WITH {_TYPED_SQL} SELECT sense_1, sense_2, relationship_type, relationship_confidence, round(ratio, 6) AS negative_support_ratio, rec AS recurrence_condition_met FROM tc")
def n_typed_pairs(spark, sf_dir):
    return _typed(spark, sf_dir).select("sense_1", "sense_2", "relationship_type", "relationship_confidence", "negative_support_ratio", "recurrence_condition_met")


@query(f"""WITH RECURSIVE {_TYPED_SQL}, ed AS (SELECT sense_1 AS a, sense_2 AS b FROM tc WHERE relationship_type = 'near_equivalent' AND relationship_confidence >= 0.55 AND same_sentence_cooccurrence >= 2), bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
reach AS (SELECT sense, sense AS seen FROM node UNION SELECT reach.sense, bo.b FROM reach JOIN bo ON bo.a = reach.seen), cl AS (SELECT sense, min(seen) AS c FROM reach GROUP BY sense), sz AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) AS r FROM cl GROUP BY c)
SELECT sense, 'SC' || lpad(r::VARCHAR, 3, '0') AS seed_cluster_id FROM cl JOIN sz USING (c)""")
def n_equivalence_clusters(spark, sf_dir):
    return pairs.equivalence_clusters(_nodes(spark, sf_dir), _typed(spark, sf_dir))


@query(f"WITH {_TYPED_SQL} SELECT DISTINCT sense_1, sense_2, relationship_type FROM tc WHERE relationship_type IN ('unsafe_to_merge', 'near_equivalent') AND (sense_1 LIKE 'EN%' OR sense_2 LIKE 'EN%')")
def i_relation_rows(spark, sf_dir):
    senses = _nodes(spark, sf_dir).filter(F.col("sense").startswith("EN"))
    return pairs.relation_rows(_typed(spark, sf_dir).select("sense_1", "sense_2", "relationship_type"), senses, ["unsafe_to_merge", "near_equivalent"])


@query(f"WITH {_PAIR_SQL}, {_NODE} SELECT a.sense AS sense_1, b.sense AS sense_2, coalesce(g.same_span_count, 0) AS same_span_count, coalesce(g.same_sentence_cooccurrence, 0) AS same_sentence_cooccurrence FROM node a JOIN node b ON a.sense < b.sense LEFT JOIN g ON g.sense_1 = a.sense AND g.sense_2 = b.sense")
def i_dense_pairs(spark, sf_dir):
    return pairs.dense(_nodes(spark, sf_dir), pairs.pair_features(_mentions(spark, sf_dir))).select("sense_1", "sense_2", "same_span_count", "same_sentence_cooccurrence")


@query(f"""WITH {fx.RT}, {fx.ANN}, {_M}, r AS (SELECT sense, span, 'by ' || llm || ' of ' || span AS about, row_number() OVER (PARTITION BY sense ORDER BY provenance) AS n FROM mention)
SELECT sense, string_agg(span, ' || ' ORDER BY n) FILTER (n <= 20) || ' || ' || string_agg(trim(about), ' || ' ORDER BY n) FILTER (n <= 5) AS node_text FROM r GROUP BY sense""")
def u_node_texts(spark, sf_dir):
    m = _mentions(spark, sf_dir).withColumn("local_context", F.concat(F.lit("by  "), "llm", F.lit(" of "), "span"))
    return mentions.node_texts(m, "sense", "provenance")


@query("SELECT array_to_string(t, ' | ') AS signature_terms, count(DISTINCT lang) AS n_folds, string_agg(DISTINCT lang, ',' ORDER BY lang) AS folds, sum(n_chars)::BIGINT AS total_mentions FROM (SELECT lang, n_chars, ['t' || doc_id % 4, 'u' || doc_id % 3] AS t FROM documents) GROUP BY ALL")
def n_recurrence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("fold_id"), F.col("n_chars").alias("n_mentions"), F.array(F.concat(F.lit("t"), F.col("doc_id") % 4), F.concat(F.lit("u"), F.col("doc_id") % 3)).alias("suggested_terms"))
    return pairs.recurrence(d)


# Evidence units


def _mappings(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir)
    w = lambda i: F.coalesce(F.try_element_at("tk", F.lit(i + 1)), F.lit("zero"))
    d = F.col("doc_id")
    lines = F.concat(F.lit("- ICO:"), F.lpad((d % 90).cast("string"), 4, "0"), F.lit(" "), w(1), F.lit("\n* "), w(4), F.lit(" of it\n* "), w(4), F.lit(" of it\nx\n"))
    nested = F.concat(F.lit('{"label": "'), w(1), F.lit('", "parts": [{"id": "n'), d % 9, F.lit('"}, {"span": "'), w(4), F.lit('"}]}'))
    raw = F.when(d % 3 == 0, lines).when(d % 3 == 1, nested).otherwise(" ")
    return rt.select("roundtrip_id", "doc_id", F.concat(F.lit("s"), F.floor(d / 2)).alias("sentence_id"), "information_model", "llm", "meaning_preserved", "original_text", "reconstructed_text", w(1).alias("w1"), w(4).alias("w4"), raw.alias("forward_mapping"))


_UNITS = f"""{fx.RT}, b AS (SELECT doc_id, roundtrip_id, 's' || doc_id // 2 AS sentence_id, information_model, llm, meaning_preserved, original_text, coalesce(tk[2], 'zero') AS w1, coalesce(tk[5], 'zero') AS w4, lpad((doc_id % 90)::VARCHAR, 4, '0') AS d4 FROM rt),
uu AS (SELECT *, unnest(CASE doc_id % 3
   WHEN 0 THEN [{{'i': 'ICO:' || d4, 'l': 'ICO:' || d4, 's': 'ICO:' || d4, 'm': 'regex_id'}}, {{'i': '', 'l': 'ICO:' || d4 || ' ' || w1, 's': 'ICO:' || d4 || ' ' || w1, 'm': 'mapping_line'}}, {{'i': '', 'l': w4 || ' of it', 's': w4 || ' of it', 'm': 'mapping_line'}}]
   WHEN 1 THEN [{{'i': '', 'l': w1, 's': w1, 'm': 'json_object'}}, {{'i': 'n' || doc_id % 9, 'l': 'n' || doc_id % 9, 's': 'n' || doc_id % 9, 'm': 'json_object'}}]
     || CASE WHEN lower(w4) <> lower(w1) THEN [{{'i': '', 'l': w4, 's': w4, 'm': 'json_object'}}] ELSE [] END
     || CASE WHEN length(w1) + length(w4) + length((doc_id % 9)::VARCHAR) + 50 <= 240 THEN [{{'i': '', 'l': line, 's': line, 'm': 'mapping_line'}}] ELSE [] END
   ELSE [{{'i': '', 'l': information_model, 's': substr(original_text, 1, 240), 'm': 'original_text_fallback'}}] END) AS u
  FROM (SELECT *, '{{"label": "' || w1 || '", "parts": [{{"id": "n' || doc_id % 9 || '"}}, {{"span": "' || w4 || '"}}]}}' AS line FROM b)),
ev AS (SELECT doc_id, roundtrip_id, sentence_id, information_model, llm, meaning_preserved, u.i AS source_element_id, u.l AS label, u.s AS span, u.m AS method, CASE WHEN u.i <> '' THEN u.i ELSE 'derived:' || substr(sha1(information_model || '||' || u.l || '||' || u.s), 1, 12) END AS source_element_key FROM uu)"""


def _evidence(spark, sf_dir):
    # a word that is a number belongs to its line
    return evidence.evidence(_mappings(spark, sf_dir), fx.CUES, bullet=evidence.LIST_MARKS)


@query(f"WITH {_UNITS} SELECT roundtrip_id, source_element_id, label, span, method, source_element_key FROM ev")
def u_evidence_units(spark, sf_dir):
    return _evidence(spark, sf_dir).select("roundtrip_id", "source_element_id", "label", "span", "method", "source_element_key")


_EDGE_CUES = " + ".join("(" + " OR ".join(f"contains(x, '{t}')" for t in terms) + ")::INT" for terms in fx.CUES.values())


@query(f"""WITH {_UNITS}, x AS (SELECT lower(concat_ws(' ', span, label, original_text, reconstructed_text)) AS x FROM ev JOIN rt USING (doc_id))
SELECT edge_type, count(*) AS n FROM (SELECT unnest(['evidence_for_roundtrip', 'evidence_for_sentence', 'maps_to_source_element', 'belongs_to_source_model']) AS edge_type FROM ev UNION ALL SELECT unnest(['has_sentence', 'uses_information_model', 'generated_by_llm']) FROM rt) GROUP BY ALL
UNION ALL SELECT 'matches_cue_group', sum({_EDGE_CUES})::BIGINT FROM x""")
def n_evidence_edges(spark, sf_dir):
    return evidence.edges(_evidence(spark, sf_dir)).groupBy("edge_type").agg(F.count("*").alias("n"))


@query(f"WITH {_UNITS} SELECT information_model, source_element_key, label, count(*) AS n_evidence_units, count(DISTINCT sentence_id) AS n_sentences, round(avg(meaning_preserved), 6) AS preserved_rate FROM ev GROUP BY ALL")
def u_evidence_frequencies(spark, sf_dir):
    return evidence.frequencies(_evidence(spark, sf_dir)).withColumn("preserved_rate", r6("preserved_rate"))


@query(f"WITH {_UNITS}, k AS (SELECT DISTINCT roundtrip_id, source_element_key AS e FROM ev) SELECT x.e AS a, y.e AS b, count(*) AS n_roundtrips FROM k x JOIN k y ON x.roundtrip_id = y.roundtrip_id AND x.e < y.e GROUP BY ALL")
def n_evidence_pairs(spark, sf_dir):
    return relational.pairs_within(_evidence(spark, sf_dir), "roundtrip_id", "source_element_key").groupBy("a", "b").agg(F.count("*").alias("n_roundtrips"))


# Packets


@query(_R + """, i AS (SELECT doc_id, ann_idx, span, resolved_id, strpos(original_text, span) - 1 AS st FROM resolved JOIN rt USING (doc_id) WHERE status IN ('valid', 'repaired')),
k AS (SELECT *, span <> '' AND NOT (len(string_split(trim(regexp_replace(span, '\\W+', ' ', 'g')), ' ')) >= 0.85 * n AND trim(regexp_replace(span, '\\W+', ' ', 'g')) <> '') AS kept FROM (SELECT i.*, len(string_split(trim(regexp_replace(original_text, '\\W+', ' ', 'g')), ' ')) AS n FROM i JOIN rt USING (doc_id)))
SELECT doc_id, coalesce(string_agg(resolved_id, ';' ORDER BY st, length(span) DESC, 'a' || ann_idx) FILTER (kept), '') AS ids, count(*) FILTER (kept) AS n_eligible FROM k GROUP BY doc_id""")
def u_packets(spark, sf_dir):
    inv = fx.inventory(spark, sf_dir)
    r = resolve.resolve(_given(spark, sf_dir), inv).filter("status in ('valid', 'repaired')").withColumn("annotation_id", F.concat(F.lit("a"), "ann_idx"))
    o = packets.ordered(packets.items(r, inv, "original_text"), ["doc_id"])
    return o.select("doc_id", F.array_join("ordered_items.label_id", ";").alias("ids"), F.col("n_eligible").cast("long").alias("n_eligible"))


@query("""WITH u AS (SELECT doc_id, ['a1', 'a' || doc_id % 4, 'a9'] AS one, ['a2', 'zz'] AS two FROM documents), v AS (SELECT doc_id, list_filter(one, lambda x: x IN ('a0', 'a1', 'a2')) AS ids FROM u) SELECT doc_id, 'rel1' AS relationship_id, 'nested_broad_narrow' AS relationship_type, array_to_string(ids, ',') AS ids FROM v WHERE len(ids) >= 2""")
def e_relationship_links(spark, sf_dir):
    d = F.col("doc_id")
    raw = F.concat(F.lit('[{"annotation_ids": ["a1", "a'), d % 4, F.lit('", "a9"], "relationship": "Broad-Narrow"}, {"unit_id": "u2", "annotation_ids": ["a2", "zz"], "relationship": "single"}]'))
    units = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    found = table(spark, sf_dir, "documents").select("doc_id", F.inline(packets.links(units, F.array(*map(F.lit, ("a0", "a1", "a2"))))))
    return found.select("doc_id", "relationship_id", "relationship_type", F.array_join("annotation_ids", ",").alias("ids"))


@query("""WITH a AS (SELECT doc_id, 'f' || doc_id % 4 AS field_id, CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE 'some span' END AS span, (['high', 'low', 'odd'])[doc_id % 3 + 1] AS v FROM documents)
SELECT doc_id, field_id, field_id IN ('f0', 'f1', 'f2') AND trim(span) <> '' AS valid, CASE WHEN field_id IN ('f0', 'f1', 'f2') THEN concat_ws(',', CASE WHEN field_id <> 'f1' AND v <> 'odd' THEN 'm1' END, CASE WHEN field_id = 'f1' OR field_id = 'f0' THEN 'm2' END) WHEN v <> 'odd' THEN 'm1' ELSE '' END AS names FROM a""")
def e_sanitised(spark, sf_dir):
    fields = spark.sql("SELECT * FROM VALUES ('f0', 'zero', array()), ('f1', 'one', array('m2')), ('f2', 'two', array('m1', 'm2')) AS t(field_id, field_name, a)").select("field_id", "field_name", F.col("a").cast("array<string>").alias("allowed_modifiers"))
    mods = spark.sql("SELECT * FROM VALUES ('m1', array('all'), array('high', 'low')), ('m2', array('zero', 'one'), array()) AS t(name, x, y)").select("name", F.col("x").cast("array<string>").alias("applies_to"), F.col("y").cast("array<string>").alias("allowed_values"))
    d = F.col("doc_id")
    value = F.element_at(F.array(*map(F.lit, ("high", "low", "odd"))), (d % 3 + 1).cast("int"))
    given = F.array(F.struct(F.lit("m1").alias("name"), value.alias("value")), F.struct(F.lit("m2").alias("name"), F.lit("any").alias("value")), F.struct(F.lit("m3").alias("name"), F.lit("any").alias("value")))
    a = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("ann_idx"), F.lit("a1").alias("annotation_id"), F.concat(F.lit("f"), d % 4).alias("field_id"), F.when(d % 6 == 0, " ").otherwise("some span").alias("span"), given.alias("modifiers"))
    return packets.sanitised(a, fields, mods, ["doc_id"]).select("doc_id", "field_id", "valid", F.array_join("modifiers.name", ",").alias("names"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'unmatched_language;rationale' WHEN 1 THEN 'rationale' ELSE '' END AS hits FROM documents")
def b_banned_keys(spark, sf_dir):
    d = F.col("doc_id")
    packet = F.concat(F.lit('{"ordered": [], '), F.when(d % 3 == 0, '"unmatched_language": [], "rationale": ""').when(d % 3 == 1, '"rationale": "x"').otherwise('"links": []'), F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(packets.banned_keys(packet), ";").alias("hits"))


@query(f"WITH {fx.RT} SELECT doc_id, 'Sentence: ' || original_text || chr(10) || 'Dictionary: E1' AS content FROM rt")
def q_messages(spark, sf_dir):
    m = packets.messages("Answer in JSON.", "Sentence: {sentence}\nDictionary: {dictionary}", sentence=F.col("original_text"), dictionary=F.lit("E1"))
    return fx.roundtrips(spark, sf_dir).select("doc_id", m[1]["content"].alias("content"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN true ELSE false END AS na_only FROM documents""")
def b_na_only(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ("NA [NA] (permit)", "[ n/a ]", "none [none]; [unknown] ()", "data [NA] (permit)", "x [E1] (deny)"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.na_only(raw).alias("na_only"))


@query("""WITH l AS (SELECT doc_id, 'l' || doc_id % 5 AS k, length(source) AS n FROM documents) SELECT a.doc_id AS doc_id, a.k, round(avg(b.n), 6) AS mean_n FROM l a LEFT JOIN l b ON a.k = b.k AND b.doc_id % 2 = 0 GROUP BY ALL""")
def i_keyed_lookup(spark, sf_dir):
    l = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("l"), F.col("doc_id") % 5).alias("k"), F.length("source").alias("n"))  # noqa: E741
    means = l.filter("doc_id % 2 = 0").groupBy("k").agg(r6(F.avg("n")).alias("mean_n"))
    return l.select("doc_id", "k").join(means, "k", "left").select("doc_id", "k", "mean_n")
