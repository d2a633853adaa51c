"""Registered queries of inventories, retrieval, the model layer and reviews, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import sets, text
from spanloom.operators import crosswalk, evaluation, inventory, models, retrieval, review, sparse_svd, stages
from spanloom.plans import fixtures as fx
from spanloom.plans.catalog import _TFIDF, query, r6
from spanloom.session import fresh_path, table


@query("""WITH n AS (SELECT DISTINCT doc_id % 40 AS n FROM documents)
SELECT 'p' || n AS prompt, k AS source_order, CASE k WHEN 1 THEN 'ICO:0' || n ELSE 'ICO:1' || n END AS source_element_id, CASE k WHEN 1 THEN 'first thing' ELSE 'second' END AS source_element_label, CASE k WHEN 1 THEN 'a wrapped definition of it' ELSE 'its own words' END AS source_element_definition FROM n, (SELECT unnest([1, 2]) AS k)""")
def e_prompt_dictionary(spark, sf_dir):
    n = (F.col("doc_id") % 40).cast("string")
    body = F.concat(F.lit("You annotate.\nICO:9999 not yet\nUse only these labels:\nelement id | definition\nan orphan line\nICO:0"), n, F.lit(' first thing "a wrapped\n definition of it"\n\n- ICO:1'), n, F.lit(" second – its own\nwords\nOutput format\nICO:8888 no more"))
    prompts = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), n).alias("prompt"), F.lit("ICO").alias("model"), body.alias("body")).distinct()
    lines = inventory.element_lines(prompts, "prompt", "model", "body").withColumn("line", F.regexp_replace("line", "^- ", ""))
    return inventory.elements(lines, "model").select("prompt", F.col("source_order").cast("int").alias("source_order"), "source_element_id", "source_element_label", "source_element_definition")


@query("SELECT query_id, item_id, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS g, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, item_id) AS s FROM (SELECT doc_id % 20 AS query_id, doc_id AS item_id, source, (doc_id * 37 % 101) / 101 AS score FROM documents)) WHERE g <= 5 OR s <= 2")
def o_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").alias("item_id"), "source", ((F.col("doc_id") * 37 % 101) / 101).alias("score"))
    return inventory.candidates(d, "query_id", "item_id", "source", 5, 2).select("query_id", "item_id", "source", "rank")


_CHARS = "w AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w0 FROM benchmark), p AS (SELECT item_id, ' ' || w0 || ' ' AS w, unnest([3, 4, 5]) AS n FROM w), g AS (SELECT item_id, unnest(list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n))) AS term FROM p WHERE length(w) >= n)"


@query(f"WITH {_CHARS}, tf AS (SELECT item_id, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT item_id) AS n FROM tf), x AS (SELECT item_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term), n) SELECT item_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS w FROM x")
def o_char_tfidf(spark, sf_dir):
    return retrieval.weights(retrieval.char_grams(table(spark, sf_dir, "benchmark"), "item_id", "text"), "item_id").select("item_id", "term", r6("w").alias("w"))


@query(f"""WITH {fx.RT}, pr AS (SELECT doc_id, original_text AS a, reconstructed_text AS b FROM rt), s AS (SELECT doc_id, 0 AS side, a AS t FROM pr UNION ALL SELECT doc_id, 1, b FROM pr),
w AS (SELECT doc_id, side, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM s), g AS (SELECT doc_id, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT doc_id, side, term, count(*) AS tf FROM g GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), x AS (SELECT doc_id, side, term, tf * (ln((1 + (SELECT count(*) FROM s)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term)), v AS (SELECT doc_id, side, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, side)) AS w FROM x)
SELECT pr.doc_id, round(coalesce(sum(p.w * q.w), 0), 6) AS cosine FROM pr LEFT JOIN v p ON p.doc_id = pr.doc_id AND p.side = 0 LEFT JOIN v q ON q.doc_id = pr.doc_id AND q.side = 1 AND q.term = p.term GROUP BY pr.doc_id""")
def f_paired_tfidf(spark, sf_dir):
    pr = fx.roundtrips(spark, sf_dir).select("doc_id", F.col("original_text").alias("a"), F.col("reconstructed_text").alias("b"))
    return models.paired_tfidf(pr, "doc_id", "a", "b").select("doc_id", r6("cosine").alias("cosine"))


_STOP = ["the", "of", "in", "an"]


@query(f"WITH {_TFIDF.replace('tf AS (SELECT item_id, term, count(*) AS tf FROM g GROUP BY ALL)', f'h AS (SELECT * FROM g WHERE len(list_filter(string_split(term, chr(32)), lambda t: t IN {tuple(_STOP)})) = 0), tf AS (SELECT item_id, term, count(*) AS tf FROM h GROUP BY ALL)')}, z AS (SELECT item_id % 4 AS cluster, count(*) AS n FROM benchmark GROUP BY ALL), m AS (SELECT item_id % 4 AS cluster, term, sum(w) AS s FROM v GROUP BY ALL) SELECT cluster, term, round(s / n, 6) AS weight FROM m JOIN z USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(s / n, 9) DESC, term) <= 8")
def o_top_terms(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("cluster", F.col("item_id") % 4)
    return models.top_terms(b, "item_id", "cluster", "text", _STOP, 8).select("cluster", "term", r6("weight").alias("weight"))


@query(f"WITH {fx.RT}, t AS (SELECT * FROM rt WHERE meaning_preserved IS NOT NULL), b AS (SELECT CASE WHEN avg(meaning_preserved) >= 0.5 THEN 1.0 ELSE 0.0 END AS s FROM t WHERE doc_id % 2 = 0) SELECT count(*) AS n, round(avg((s = meaning_preserved)::INT), 6) AS accuracy FROM t, b WHERE doc_id % 2 = 1")
def o_majority(spark, sf_dir):
    t = fx.roundtrips(spark, sf_dir).filter("meaning_preserved is not null").withColumn("y", F.col("meaning_preserved"))
    scored = models.majority(t.filter("doc_id % 2 = 0"), t.filter("doc_id % 2 = 1").select("doc_id", "y"))
    return evaluation.metrics(scored, []).select("n", r6("accuracy").alias("accuracy"))


@query("SELECT vec_id, round(CASE vec_id % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 0.4 END, 6) AS nli_min, round(CASE vec_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 0.7 END, 6) AS nli_max, round(CASE vec_id % 3 WHEN 0 THEN 0.7 WHEN 1 THEN 0.0 ELSE 0.3 END, 6) AS nli_gap FROM embeddings")
def o_both_ways(spark, sf_dir):
    k = F.col("vec_id") % 3
    f, b = F.when(k == 0, 0.9).when(k == 1, 0.5).otherwise(0.4), F.when(k == 0, 0.2).when(k == 1, 0.5).otherwise(0.7)
    return table(spark, sf_dir, "embeddings").select("vec_id", *(r6(c).alias(n) for n, c in models.both_ways(f, b).items()))


@query(f"""WITH {fx.RT}, r AS (SELECT llm, information_model AS feature_set, condition AS model, avg(((score >= 0.5)::INT = meaning_preserved)::INT) AS accuracy FROM rt WHERE meaning_preserved IS NOT NULL GROUP BY ALL)
SELECT feature_set, model, count(*) AS n_splits, round(avg(accuracy), 6) AS mean_accuracy FROM r GROUP BY ALL""")
def j_mean_over_splits(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir).filter("meaning_preserved IS NOT NULL")
    right = ((F.col("score") >= 0.5).cast("int") == F.col("meaning_preserved")).cast("int")
    r = rt.groupBy("llm", F.col("information_model").alias("feature_set"), F.col("condition").alias("model")).agg(F.avg(right).alias("accuracy"))
    return models.mean_over_splits(r, ["accuracy"]).withColumn("mean_accuracy", r6("mean_accuracy"))


@query()
def o_experiments(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir).filter("meaning_preserved is not null")
    f = rt.select("doc_id", "form_id", "llm", F.col("meaning_preserved").alias("y"), F.size("tk").cast("double").alias("length_ratio"), sets.jaccard(F.col("tk"), F.col("rk")).alias("token_jaccard"), F.col("original_text").alias("pair_text"))
    members, schemes = evaluation.experiment_splits(f, "doc_id", "y", "form_id", {}, n_folds=2)
    tests = evaluation.split_tests(members, "y", schemes)
    ready = evaluation.term_counts(members, "y", tests, "pair_text")
    splits = evaluation.split_frames(ready, "y", schemes, tests)
    return models.experiments(splits, {"hybrid": models.feature_sets(f, [], text="pair_text_counts")["hybrid"]}, ["lr"])


@query(f"WITH {fx.RT}, t AS (SELECT *, (score >= threshold) AS hit FROM rt, (SELECT unnest([0.5, 0.7, 0.8, 0.9])::DOUBLE AS threshold) WHERE meaning_preserved IS NOT NULL) SELECT llm, threshold, count(*) AS n, round(avg(hit::INT), 6) AS retained, count(*) FILTER (hit) AS n_retained, round(coalesce(count(*) FILTER (hit AND meaning_preserved = 1) / nullif(count(*) FILTER (hit), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (hit AND meaning_preserved = 1) / nullif(count(*) FILTER (meaning_preserved = 1), 0), 0), 6) AS recall FROM t GROUP BY ALL")
def o_threshold_table(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir).filter("meaning_preserved IS NOT NULL").withColumn("y", F.col("meaning_preserved"))
    r = evaluation.retention(rt, ["llm"], label="y")
    return r.withColumns({c: r6(c) for c in ("retained", "precision", "recall")})


_STAGED = "SELECT condition, count(*) AS n, sum(n_tokens)::BIGINT AS n_tokens, round(avg(share), 6) AS mean_share FROM (SELECT condition, len(tk) AS n_tokens, len(rk) / greatest(1, len(tk)) AS share FROM rt) GROUP BY condition"


@query(f"WITH {fx.RT} {_STAGED}")
def r_staged_summary(spark, sf_dir):
    def measured(_, given):
        return given["pairs"].select("condition", F.size("tk").alias("n_tokens"), (F.size("rk") / F.greatest(F.lit(1), F.size("tk"))).alias("share"))

    def summary(_, given, digits):
        return given["measured"].groupBy("condition").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("n_tokens"), F.round(F.avg("share"), digits).alias("mean_share"))

    tables = {t: f"{sf_dir}/{t}.parquet" for t in ("documents", "labels")}
    study = [stages.Stage("pairs", lambda s, given: fx.roundtrips(s, sf_dir), paths=tables), stages.Stage("measured", measured, ("pairs",)), stages.Stage("summary", summary, ("measured",), options={"digits": 6})]
    return stages.run(spark, study, fresh_path(spark, "study"))[0]["summary"]


@query()
def o_kmeans(spark, sf_dir):
    return models.kmeans(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 4).select("vec_id", "cluster")


@query()
def o_reduced_vectors(spark, sf_dir):
    return models.reduced(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 4)


@query()
def o_sparse_svd(spark, sf_dir):
    return sparse_svd.text_vectors(table(spark, sf_dir, "documents"), "doc_id", "text", 16)[0]


# Reviews

_SAMPLE = "s AS (SELECT form_id FROM (SELECT form_id, count(DISTINCT condition) AS c, count(DISTINCT llm) AS l FROM rt GROUP BY form_id) WHERE c >= 2 AND l >= 2 ORDER BY sha1(form_id || '|17'), form_id LIMIT 5)"


def _sample(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir)
    return rt, review.fixed_sample(rt, "form_id", 5, 17, {"condition": 2, "llm": 2})


@query(f"WITH {fx.RT}, {_SAMPLE} SELECT form_id FROM s")
def p_fixed_sample(spark, sf_dir):
    return _sample(spark, sf_dir)[1]


@query(f"WITH {fx.RT}, {_SAMPLE} SELECT form_id, condition, min(doc_id) AS doc_id FROM rt WHERE form_id IN (SELECT form_id FROM s) GROUP BY ALL")
def u_examples(spark, sf_dir):
    rt, s = _sample(spark, sf_dir)
    return review.examples(rt.select("form_id", "condition", "doc_id"), s, "form_id", "condition", "doc_id")


@query(f"WITH {fx.RT}, r AS (SELECT condition, llm, doc_id, score, row_number() OVER (PARTITION BY condition, llm ORDER BY score, doc_id) AS r FROM rt) SELECT condition, llm, doc_id FROM r WHERE r <= 3 ORDER BY r, condition, llm, score, doc_id LIMIT 20")
def u_review_rows(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir).select("condition", "llm", "doc_id", "score")
    return review.review_rows(rt, ["condition", "llm"], [F.asc("score"), F.asc("doc_id")], 3, 20).select("condition", "llm", "doc_id")


@query("SELECT doc_id, 'a &lt;b&gt; <mark title=\"E&amp;1\">cde</mark> &quot;f&quot; ' || doc_id AS html, 'cde -> E1 (permit)' || chr(10) || 'x -> E2' AS preview FROM documents")
def r_highlighted(spark, sf_dir):
    body = F.concat(F.lit('a <b> cde "f" '), "doc_id")
    span = lambda a, b, n: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(n).alias("label"))
    ann = lambda s, n, d: F.struct(F.lit(s).alias("span"), F.lit(n).alias("label"), F.lit(d).alias("decision"))
    return table(spark, sf_dir, "documents").select("doc_id", review.highlighted(body, F.array(span(6, 9, "E&1"), span(7, 8, "no"))).alias("html"), review.preview(F.array(ann("cde", "E1", "permit"), ann("x", "E2", ""))).alias("preview"))


@query("""WITH c AS (SELECT label AS cluster, vec_id % 2 AS y, 'm' || vec_id % 3 AS m FROM embeddings), k AS (SELECT cluster, m, count(*) AS n FROM c GROUP BY ALL), l AS (SELECT cluster, string_agg(m || ':' || n, ';' ORDER BY n DESC, m) AS models FROM k GROUP BY cluster)
SELECT cluster, count(*) AS n, round(avg(y), 6) AS preserved_rate, any_value(models) AS models FROM c JOIN l USING (cluster) GROUP BY cluster""")
def u_cluster_summary(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), (F.col("vec_id") % 2).alias("y"), F.concat(F.lit("m"), F.col("vec_id") % 3).alias("m"))
    return review.cluster_summary(c, "cluster", "y", {"m": "models"}).withColumn("preserved_rate", r6("preserved_rate"))


@query("SELECT DISTINCT lang AS field, 'manual' AS dictionary, NULL AS fold FROM documents UNION SELECT DISTINCT lang, 'induced', 'fold_0' || doc_id % 2 FROM documents UNION SELECT DISTINCT lang, 'consensus', NULL FROM documents")
def u_dictionaries(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    one = d.select(F.col("lang").alias("field"))
    return review.dictionaries(one, d.select(F.col("lang").alias("field"), F.concat(F.lit("fold_0"), F.col("doc_id") % 2).alias("fold")), one).select("field", "dictionary", "fold")


@query("SELECT source, max(length(lang)) AS longest FROM documents GROUP BY source")
def r_source_dictionary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang")
    return crosswalk.dictionary([d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1").withColumn("note", F.lit(None).cast("string"))], "source").select("source", F.length("lang").alias("longest"))


@query("SELECT source, fold FROM (SELECT source, ('0x' || substr(sha1(source), 1, 8))::BIGINT % 4 AS fold FROM documents GROUP BY source) WHERE fold <> 1")
def p_training_forms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source").distinct()
    return d.select("source", evaluation.hash_fold(F.col("source"), 4).alias("fold")).filter("fold <> 1")


@query("SELECT doc_id, 'v2' AS condition, 'EN model' AS information_model FROM documents")
def a_relabelled(spark, sf_dir):
    return review.relabelled(table(spark, sf_dir, "documents").select("doc_id"), condition="v2", information_model="EN model")


@query("SELECT doc_id, NOT contains(lower(s), 'sentence') AS span_level FROM (SELECT doc_id, (['span', 'Sentence-Level', 'sentence_level', ''])[doc_id % 4 + 1] AS s FROM documents)")
def b_scope(spark, sf_dir):
    s = F.element_at(F.array(*map(F.lit, ("span", "Sentence-Level", "sentence_level", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", (~text.sentence_scope(s)).alias("span_level"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'a reason' WHEN 1 THEN 'preflagged_na_only_annotation_row' WHEN 2 THEN 'legacy_na_only_annotation:serialized' WHEN 3 THEN 'zero_valid_span_annotation_evidence' ELSE '' END AS reason FROM documents""")
def b_exclusion_cascade(spark, sf_dir):
    k = F.col("doc_id") % 6
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (k == 0).alias("excluded"), F.when(k == 0, "a reason").otherwise("").alias("why"), (k == 1).alias("na"), F.when(k == 2, "NA [NA] (permit)").when(k == 4, "data [E1] (permit)").otherwise("").alias("serialized"),
        F.when(k == 5, 2).otherwise(0).alias("n_valid"),
    )
    evidence = text.valid_evidence([F.col("n_valid")], F.array().cast("array<struct<span:string,label:string>>"), [F.col("serialized")])
    return rows.select("doc_id", text.exclusion(F.col("excluded"), F.col("why"), F.col("na"), {"serialized": F.col("serialized")}, evidence).alias("reason"))



@query("SELECT doc_id, upper(lang) AS source_model, 'E' || doc_id % 3 AS source_element_id, 'label ' || doc_id % 3 AS source_element_label FROM documents")
def e_card_elements(spark, sf_dir):
    d = F.col("doc_id") % 3
    one = F.concat(F.lit('{"source_model": "'), F.upper("lang"), F.lit('", "element_id": "E'), d, F.lit('", "name": "label '), d, F.lit('"}'))
    body = F.when(d == 0, F.concat(F.lit('{"nodes": ['), one, F.lit(", "), one, F.lit("]}"))).otherwise(F.concat(F.lit('{"nodes": [], "members": ['), one, F.lit("]}")))
    return crosswalk.source_elements(table(spark, sf_dir, "documents").select("doc_id", body.alias("body")), "doc_id", "body")
