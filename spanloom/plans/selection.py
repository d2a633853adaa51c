"""Registered queries of cross-fold selection, order statistics and splits, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import evaluation, order, schema, stability
from spanloom.plans import fixtures as fx
from spanloom.plans.catalog import query, r6
from spanloom.session import stored, table

# Fields of four folds: what documents of one language and source say most often

_LEAST, _CORE, _EXTENSION, _JACCARD = 2, (3, 24), (2, 8), 0.6
_ARTIFACTS = "(" + ", ".join(f"'{w}'" for w in schema.ARTIFACTS) + ")"
_STABLE = f"""WITH RECURSIVE {fx.RT}, r0 AS (SELECT *, 'fold_0' || (doc_id // 20 % 4) AS fold, coalesce(information_model, 'none') || '_' || form_id AS field FROM rt),
c AS (SELECT fold, field, count(*) AS n_mentions, count(*) FILTER (meaning_preserved IS DISTINCT FROM 0) AS n_positive, count(DISTINCT condition) AS n_models FROM r0 GROUP BY ALL),
w AS (SELECT fold, field, t, count(*) AS n FROM (SELECT fold, field, unnest(tk) AS t FROM r0) GROUP BY ALL),
k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY fold, field ORDER BY n DESC, t) <= 10),
tt AS (SELECT fold, field, list(t ORDER BY t) AS terms FROM k WHERE t NOT IN {_ARTIFACTS} GROUP BY ALL),
nodes AS (SELECT c.*, fold || '::' || field AS node, coalesce(terms, []) AS terms FROM c LEFT JOIN tt USING (fold, field)),
e AS (SELECT a.node AS a, b.node AS b FROM nodes a JOIN nodes b ON a.fold <> b.fold AND a.n_positive >= {_LEAST} AND b.n_positive >= {_LEAST} AND len(a.terms) > 0 AND len(b.terms) > 0
  WHERE len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms))) >= {_JACCARD}::DOUBLE),
reach(node, seen) AS (SELECT node, node FROM nodes UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen),
g AS (SELECT node, min(seen) AS grp FROM reach GROUP BY node), l AS (SELECT * FROM nodes JOIN g USING (node)),
tn AS (SELECT grp, t, count(*) AS n FROM (SELECT grp, unnest(terms) AS t FROM l) GROUP BY ALL), top AS (SELECT grp, string_agg(t, ',' ORDER BY n DESC, t) AS terms FROM (SELECT * FROM tn QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, t) <= 12) GROUP BY grp),
s AS (SELECT grp, count(DISTINCT fold) AS n_folds, sum(n_positive)::BIGINT AS total, max(n_models) AS models, count(*) AS n_fields, string_agg(DISTINCT fold, ',' ORDER BY fold) AS folds FROM l GROUP BY grp),
z AS (SELECT s.*, coalesce(top.terms, '') AS top_terms, printf('SG%03d', row_number() OVER (ORDER BY n_folds DESC, total DESC, s.grp)) AS stability_group_id,
  CASE WHEN n_folds >= {_CORE[0]} AND total >= {_CORE[1]} AND models >= 2 THEN 'core_candidate' WHEN n_folds >= {_EXTENSION[0]} AND total >= {_EXTENSION[1]} AND models >= 2 THEN 'extension_candidate' ELSE 'audit_only' END AS selection_tier FROM s LEFT JOIN top ON s.grp = top.grp)"""


def _fields(spark, sf_dir):
    node = F.concat("fold", F.lit("::"), "candidate_field_id")
    rt = fx.roundtrips(spark, sf_dir).withColumns({
        "fold": F.concat(F.lit("fold_0"), F.floor(F.col("doc_id") / 20) % 4), "candidate_field_id": F.concat(F.coalesce("information_model", F.lit("none")), F.lit("_"), "form_id"),
    })
    rows = rt.select(node.alias("node"), "fold", "candidate_field_id", "condition", "meaning_preserved", F.lit(None).cast("array<string>").alias("suggested"), "tk")
    counts = rows.groupBy("fold", "candidate_field_id").agg(F.count("*").alias("n_mentions"), F.count_if(~F.col("meaning_preserved").eqNullSafe(0)).alias("n_positive_mentions"), F.countDistinct("condition").alias("n_source_models"))
    return counts.withColumn("node", node).join(schema.term_profile(rows, "node", "suggested", "tk", 10), "node").drop("node")


def _stability(spark, sf_dir):
    return stability.stability(stored(_fields(spark, sf_dir), "fields"), threshold=_JACCARD, least_support=_LEAST, core=_CORE, extension=_EXTENSION)


@query(f"{_STABLE} SELECT fold, field AS candidate_field_id, n_mentions, n_positive AS n_positive_mentions, n_models AS n_source_models, stability_group_id, selection_tier, n_folds AS stability_n_folds, total AS stability_total_support, models AS stability_max_models, top_terms FROM l JOIN z ON l.grp = z.grp")
def n_stability_groups(spark, sf_dir):
    long = _stability(spark, sf_dir)[0]
    return long.select("fold", "candidate_field_id", "n_mentions", "n_positive_mentions", "n_source_models", "stability_group_id", "selection_tier", "stability_n_folds", "stability_total_support", "stability_max_models", F.array_join("stability_top_terms", ",").alias("top_terms"))


@query(f"{_STABLE} SELECT stability_group_id, selection_tier, n_folds AS stability_n_folds, total AS stability_total_support, n_fields, folds FROM z")
def n_stability_summary(spark, sf_dir):
    s = _stability(spark, sf_dir)[1]
    return s.select("stability_group_id", "selection_tier", "stability_n_folds", "stability_total_support", "n_fields", F.array_join("folds", ",").alias("folds"))


@query(f"{_STABLE}, v AS (SELECT fold, field, selection_tier FROM l JOIN z ON l.grp = z.grp WHERE selection_tier <> 'audit_only' AND n_positive >= {_LEAST}) SELECT fold, count(*) AS n_fields, '{{\"schema_id\":\"' || fold || '\",\"fields\":[' || string_agg('{{\"name\":\"field_' || field || '\",\"status\":\"' || selection_tier || '\"}}', ',' ORDER BY field) || ']}}' AS schema_json FROM v GROUP BY fold")
def u_selected_schemas(spark, sf_dir):
    chosen = stability.selected(_stability(spark, sf_dir)[0], least_support=_LEAST)
    return schema.emit(chosen, "fold", [F.col("candidate_field_id")], name=F.concat(F.lit("field_"), "candidate_field_id"), status=F.col("selection_tier"))


_SIMILAR = f"{_STABLE} SELECT x.a, x.b, round(x.j, 6) AS jaccard FROM (SELECT DISTINCT least(ca.n, cb.n) AS a, greatest(ca.n, cb.n) AS b, j FROM (SELECT a.terms AS ta, b.terms AS tb, len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms))) AS j FROM e JOIN nodes a ON e.a = a.node JOIN nodes b ON e.b = b.node) p JOIN (SELECT terms, min(node) AS n FROM nodes WHERE n_positive >= {_LEAST} GROUP BY terms) ca ON ca.terms = ta JOIN (SELECT terms, min(node) AS n FROM nodes WHERE n_positive >= {_LEAST} GROUP BY terms) cb ON cb.terms = tb) x WHERE a <> b"


@query(_SIMILAR)
def i_cross_fold_similarity(spark, sf_dir):
    found = stored(stability.classes(_fields(spark, sf_dir), "fold", "candidate_field_id", "terms", "n_positive_mentions", _LEAST), "fold-classes")
    return stability.similar_fields(found, _JACCARD).select("a", "b", r6("jaccard").alias("jaccard"))


# Order statistics over whole tables

_SCORED = f"{fx.RT}, x AS (SELECT doc_id, llm, len(rk) / greatest(1, len(tk)) + score / 7 AS s, meaning_preserved AS y FROM rt WHERE meaning_preserved IS NOT NULL)"
_SUMS = "sum(n) AS n, round(sum(CASE WHEN (s >= 0.9) THEN p ELSE q END) / sum(n), 6) AS accuracy, round(coalesce(sum(p) FILTER (s >= 0.9) / sum(n) FILTER (s >= 0.9), 0), 6) AS precision, round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) AS auroc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision"


def _scored(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir).filter("meaning_preserved IS NOT NULL")
    return rt.select("doc_id", "llm", (F.size("rk") / F.greatest(F.lit(1), F.size("tk")) + F.col("score") / 7).alias("score"), F.col("meaning_preserved").alias("y"))


def _metrics(by):
    over = f"PARTITION BY {by} " if by else ""
    of = f"{by}, " if by else ""
    return f"WITH {_SCORED}, d AS (SELECT {of}s, sum(y) AS p, count(*) - sum(y) AS q, count(*) AS n FROM x GROUP BY ALL), c AS (SELECT *, sum(p) OVER ({over}ORDER BY s DESC) AS tp, sum(q) OVER ({over}ORDER BY s DESC) AS fp FROM d) SELECT {of}{_SUMS.replace('sum(n) AS n', 'sum(n)::BIGINT AS n')} FROM c" + (f" GROUP BY {by}" if by else "")


_METRIC_NAMES = ("accuracy", "precision", "auroc", "average_precision")


@query(_metrics(""))
def o_global_metrics(spark, sf_dir):
    return evaluation.metrics(_scored(spark, sf_dir), [], threshold=0.9).select("n", *(r6(c).alias(c) for c in _METRIC_NAMES))


@query(_metrics("llm"))
def o_metrics_by_llm(spark, sf_dir):
    return evaluation.metrics(_scored(spark, sf_dir), ["llm"], threshold=0.9).select("llm", "n", *(r6(c).alias(c) for c in _METRIC_NAMES))


@query("SELECT round(median(l_extendedprice)::DOUBLE, 6) AS median_l_extendedprice, round(quantile_cont(l_extendedprice::DOUBLE, 0.9), 6) AS p90_l_extendedprice, round(median(l_quantity)::DOUBLE, 6) AS median_l_quantity, round(quantile_cont(l_quantity::DOUBLE, 0.9), 6) AS p90_l_quantity FROM lineitem")
def j_global_quantiles(spark, sf_dir):
    q = order.quantiles(table(spark, sf_dir, "lineitem"), [], ["l_extendedprice", "l_quantity"], {"median": 0.5, "p90": 0.9})
    return q.select(*(r6(c).alias(c) for c in q.columns))


@query("SELECT l_returnflag, l_linestatus, round(median(l_extendedprice::DOUBLE), 6) AS median_l_extendedprice, round(quantile_cont(l_extendedprice::DOUBLE, 0.25), 6) AS p25_l_extendedprice FROM lineitem GROUP BY ALL")
def j_grouped_quantiles(spark, sf_dir):
    q = order.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_extendedprice"], {"median": 0.5, "p25": 0.25})
    return q.select("l_returnflag", "l_linestatus", *(r6(c).alias(c) for c in q.columns[2:]))


# Splits

_STRATIFIED = """l AS (SELECT doc_id, quality AS y FROM labels WHERE quality IS NOT NULL), n AS (SELECT y, count(*) AS c, sum(count(*)) OVER () AS t FROM l GROUP BY y),
q AS (SELECT y, c, ceil(0.2 * t)::BIGINT AS w, t FROM n), b AS (SELECT *, (w * c // t)::BIGINT AS base, row_number() OVER (ORDER BY w * c % t DESC, c DESC, y) AS place, (w - sum(w * c // t) OVER ())::BIGINT AS rest FROM q),
st AS (SELECT l.doc_id, l.y, row_number() OVER (PARTITION BY l.y ORDER BY sha1(doc_id || '|42'), doc_id) <= base + (place <= rest)::INT AS test FROM l JOIN b USING (y))"""


@query(f"WITH {_STRATIFIED} SELECT doc_id, y, test FROM st")
def p_stratified_split(spark, sf_dir):
    return evaluation.stratified(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id", "y")


_FOLDS = """gs AS (SELECT {g} AS g, count(*) AS n_rows FROM {t} GROUP BY ALL), gn AS (SELECT *, row_number() OVER (ORDER BY n_rows DESC, g) AS i FROM gs WHERE g IS NOT NULL),
dealt(i, g, n_rows, fold, load) AS (SELECT 0::BIGINT, NULL::{k}, 0::BIGINT, 0::BIGINT, [0::BIGINT, 0, 0, 0, 0] UNION ALL
  SELECT gn.i, gn.g, gn.n_rows, list_position(load, list_min(load))::BIGINT, list_transform(load, lambda x, j: CASE WHEN j = list_position(load, list_min(load)) THEN x + gn.n_rows ELSE x END) FROM dealt JOIN gn ON gn.i = dealt.i + 1)"""


@query(f"WITH RECURSIVE {_FOLDS.format(g='conv_id', t='conversations', k='BIGINT')} SELECT g AS conv_id, n_rows, fold::INT AS fold FROM dealt WHERE i > 0")
def p_balanced_folds(spark, sf_dir):
    return evaluation.balanced_folds(table(spark, sf_dir, "conversations"), "conv_id", 5)


@query(f"""WITH RECURSIVE {fx.RT}, {_STRATIFIED}, rg AS (SELECT *, form_id || '_' || (doc_id % 100 % (1 + length(form_id))) AS grp FROM rt WHERE meaning_preserved IS NOT NULL), {_FOLDS.format(g='grp', t='rg', k='VARCHAR')},
m AS (SELECT rg.*, CASE WHEN st.test THEN '1' END AS random_split, dealt.fold AS group_fold FROM rg JOIN st USING (doc_id) JOIN dealt ON dealt.g = rg.grp),
u AS (SELECT meaning_preserved AS y, unnest(['random', 'leave_group_fold', 'leave_llm', 'leave_info_model']) AS scheme, unnest([random_split, group_fold::VARCHAR, llm, information_model]) AS value FROM m),
a AS (SELECT scheme, value, count(*) AS n_test, sum(y) AS p FROM u GROUP BY ALL), w AS (SELECT scheme, count(*) AS n, sum(y) AS ap FROM u GROUP BY ALL)
SELECT scheme, value, (n - n_test)::BIGINT AS n_train, n_test, p > 0 AND p < n_test AND ap - p > 0 AND ap - p < n - n_test AS trainable FROM a JOIN w USING (scheme) WHERE value IS NOT NULL""")
def o_split_table(spark, sf_dir):
    grp = F.concat("form_id", F.lit("_"), F.col("doc_id") % 100 % (1 + F.length("form_id")))
    rt = fx.roundtrips(spark, sf_dir).select("doc_id", "llm", "information_model", grp.alias("grp"), F.col("meaning_preserved").alias("y"))
    members, schemes = evaluation.experiment_splits(rt.filter("y IS NOT NULL"), "doc_id", "y", "grp", {"leave_llm": "llm", "leave_info_model": "information_model"})
    return evaluation.split_table(members, "y", schemes)
