"""The registered queries of the text-pair operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import cues, jsonish, sets, spans, text
from spanloom.operators import evaluation, graph, relational, retrieval, schema, senses
from spanloom.plans import fixtures as fx
from spanloom.session import table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def r6(x):
    return F.round(x, 6)


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOP) + "]"
_distinct = "list_distinct"


# A, B: projections, filters, predicates


@query(f"WITH {fx.RT} SELECT doc_id, 'ORIGINAL: ' || original_text || chr(10) || 'RECONSTRUCTION: ' || reconstructed_text AS pair_text FROM rt WHERE meaning_preserved IS NOT NULL AND length(reconstructed_text) > 0")
def b_labelled_pairs(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir).filter("meaning_preserved IS NOT NULL AND length(reconstructed_text) > 0")
    return rt.select("doc_id", F.concat(F.lit("ORIGINAL: "), "original_text", F.lit("\nRECONSTRUCTION: "), "reconstructed_text").alias("pair_text"))


@query("SELECT doc_id AS source_id, text AS original_text, NULL::VARCHAR AS llm FROM documents")
def b_candidate_columns(spark, sf_dir):
    return relational.project(table(spark, sf_dir, "documents"), {"source_id": ["sentence_id", "doc_id"], "original_text": ["full_text", "text"], "llm": ["llm", "model"]}, ("original_text",))


@query("SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'both' WHEN quality = 0 THEN 'quality' WHEN toxic = 1 THEN 'toxic' ELSE '' END AS reason, CAST(quality AS VARCHAR) IN ('true', '1', 'yes', 'y') AS yes FROM labels")
def b_exclusion_reason(spark, sf_dir):
    reason = F.when(F.expr("quality = 0 AND toxic = 1"), "both").when(F.col("quality") == 0, "quality").when(F.col("toxic") == 1, "toxic").otherwise("")
    return table(spark, sf_dir, "labels").select("doc_id", reason.alias("reason"), text.truthy(F.col("quality")).alias("yes"))


# C: text functions


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed, lower(text) AS low, length(text) - length(replace(text, '[', '')) AS brackets, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS loose, regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake, CASE WHEN length(text) <= 240 THEN text ELSE substr(text, 1, 237) || '...' END AS short FROM documents")
def c_normalised(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.collapsed(t).alias("collapsed"), F.lower(t).alias("low"), text.occurrences(t, "[").alias("brackets"), text.loose_key(t).alias("loose"), text.snake(F.col("source")).alias("snake"), text.shortened(t, 240).alias("short"))


@query(f"""WITH {fx.RT}, c AS (SELECT doc_id, tk, list_filter(tk, lambda t: length(t) > 1 AND NOT list_contains({STOP_SQL}, t)) AS ct FROM rt)
SELECT doc_id, len(tk) AS n_tokens, len({_distinct}(tk)) AS n_distinct, array_to_string(ct, ' ') AS canonical, coalesce(ct[-1], '') AS head,
  array_to_string(list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]), '|') AS bigrams FROM c""")
def c_tokens(spark, sf_dir):
    tk = F.col("tk")
    return fx.roundtrips(spark, sf_dir).select("doc_id", F.size(tk).alias("n_tokens"), F.size(F.array_distinct(tk)).alias("n_distinct"), text.canonical(tk).alias("canonical"), text.head(tk).alias("head"), F.array_join(text.bigrams(tk), "|").alias("bigrams"))


@query(f"""WITH {fx.INV} SELECT union_element_id, split_part(union_element_id, '::', 1) AS prefix, split_part(union_element_id, '::', 2) AS suffix, lower(source_model) || '|e' || source_order AS id_key FROM inv""")
def c_identifier_keys(spark, sf_dir):
    u = F.col("union_element_id")
    return fx.inventory(spark, sf_dir).select("union_element_id", text.prefix(u).alias("prefix"), text.after_first(u).alias("suffix"), text.id_key(F.regexp_replace(u, "::E", "::E")).alias("id_key"))


@query(f"""WITH {fx.RT}, p AS (SELECT doc_id, ' ' || original_text || ' ' AS s, tk FROM rt) SELECT doc_id,
 CASE WHEN len(list_filter({text.CONDITIONAL_TERMS}, lambda t: contains(s, ' ' || t || ' '))) > 0 THEN 'conditional'
  WHEN len(list_filter({[t for t in text.NEGATION_TERMS if "'" not in t]}, lambda t: contains(s, ' ' || t || ' '))) > 0 THEN 'negated'
  WHEN len(list_filter({text.UNCERTAINTY_TERMS}, lambda t: contains(s, ' ' || t || ' '))) > 0 THEN 'uncertain' ELSE 'affirmed' END AS polarity,
 CASE WHEN greatest(a, b) = 0 THEN 'other' WHEN a >= b THEN 'joining' ELSE 'placing' END AS role
 FROM (SELECT *, len(list_intersect(list_distinct(tk), ['and', 'or', 'with'])) AS a, len(list_intersect(list_distinct(tk), ['on', 'in', 'at', 'for'])) AS b FROM p)""")
def c_polarity_and_role(spark, sf_dir):
    role = text.role(F.col("tk"), {"joining": ["and", "or", "with"], "placing": ["on", "in", "at", "for"]})
    return fx.roundtrips(spark, sf_dir).select("doc_id", text.polarity(F.col("original_text")).alias("polarity"), role.alias("role"))


# D: cues


def _cue_sql(side: str, terms: list[str]) -> str:
    low = f"lower({side})"
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({low}, '{cues.pattern(t)}') THEN '{t}' END" for t in terms) + "], lambda t: t IS NOT NULL)"


def _cue_columns() -> str:
    return ", ".join(f"{_cue_sql('original_text', t)} AS o_{g}, {_cue_sql('reconstructed_text', t)} AS r_{g}" for g, t in fx.CUES.items())


def _found(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir)
    return rt.select("*", *(cues.found(F.col(side), t).alias(f"{p}_{g}") for g, t in fx.CUES.items() for p, side in (("o", "original_text"), ("r", "reconstructed_text"))))


_J = "CASE WHEN len(o_{g}) = 0 AND len(r_{g}) = 0 THEN 1.0 ELSE len(list_intersect(o_{g}, r_{g})) / len(list_distinct(list_concat(o_{g}, r_{g}))) END"


@query(f"WITH {fx.RT}, c AS (SELECT doc_id, {_cue_columns()} FROM rt) SELECT doc_id, " + ", ".join(f"len(o_{g}) AS orig_{g}_count, len(r_{g}) AS recon_{g}_count, round({_J.format(g=g)}, 6) AS {g}_jaccard, len(o_{g}) - len(list_intersect(o_{g}, r_{g})) AS {g}_missing_count, (len(o_{g}) > 0) = (len(r_{g}) > 0) AS {g}_presence_preserved" for g in fx.CUES) + " FROM c")
def d_group_features(spark, sf_dir):
    columns = [c for g in fx.CUES for c in cues.group_features(F.col(f"o_{g}"), F.col(f"r_{g}"), g)]
    df = _found(spark, sf_dir).select("doc_id", *columns)
    keep = [f"{a}{g}{b}" for g in fx.CUES for a, b in (("orig_", "_count"), ("recon_", "_count"), ("", "_missing_count"), ("", "_presence_preserved"))]
    return df.select("doc_id", *keep, *(r6(F.col(f"{g}_jaccard")).alias(f"{g}_jaccard") for g in fx.CUES))


@query(f"""WITH {fx.RT}, c AS (SELECT doc_id, llm, {_cue_columns()} FROM rt), m AS (SELECT *,
 CASE WHEN len(o_prohibition) > 0 THEN 'prohibition' WHEN len(o_obligation) > 0 THEN 'obligation' WHEN len(o_permission) > 0 THEN 'permission' ELSE 'none' END AS mo,
 CASE WHEN len(r_prohibition) > 0 THEN 'prohibition' WHEN len(r_obligation) > 0 THEN 'obligation' WHEN len(r_permission) > 0 THEN 'permission' ELSE 'none' END AS mr FROM c)
 SELECT llm, mo || ' -> ' || mr AS transition, count(*) AS n, round(avg(CASE WHEN mo <> mr THEN 1 ELSE 0 END), 6) AS changed FROM m GROUP BY ALL""")
def d_modal_transitions(spark, sf_dir):
    side = lambda p: cues.modal(*(F.col(f"{p}_{g}") for g in ("prohibition", "obligation", "permission")))
    m = _found(spark, sf_dir).select("llm", side("o").alias("mo"), side("r").alias("mr"))
    return m.groupBy("llm", F.concat("mo", F.lit(" -> "), "mr").alias("transition")).agg(F.count("*").alias("n"), r6(F.avg((F.col("mo") != F.col("mr")).cast("int"))).alias("changed"))


@query(f"WITH {fx.RT}, c AS (SELECT condition, {_cue_columns()} FROM rt), u AS (" + " UNION ALL ".join(f"SELECT condition, '{g}' AS cue_group, len(o_{g}) AS o, len(r_{g}) AS r FROM c" for g in fx.CUES) + """)
 SELECT condition, cue_group, count(*) AS n, round(avg((o > 0)::INT), 6) AS prevalence, round(avg(CASE WHEN o > 0 THEN (r > 0)::INT END), 6) AS preserved, round(sum((o = 0 AND r > 0)::INT) / greatest(1, sum((o = 0)::INT)), 6) AS added FROM u GROUP BY ALL""")
def d_cue_retention(spark, sf_dir):
    u = _found(spark, sf_dir).select("condition", F.inline(F.array(*(F.struct(F.lit(g).alias("cue_group"), F.size(f"o_{g}").alias("o"), F.size(f"r_{g}").alias("r")) for g in fx.CUES))))
    has, kept = F.col("o") > 0, F.col("r") > 0
    return u.groupBy("condition", "cue_group").agg(F.count("*").alias("n"), r6(F.avg(has.cast("int"))).alias("prevalence"), r6(F.avg(F.when(has, kept.cast("int")))).alias("preserved"), r6(F.count_if(~has & kept) / F.greatest(F.lit(1), F.count_if(~has))).alias("added"))


@query(f"WITH {fx.RT} SELECT doc_id, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(original_text, '{t}')" for t in ts) + f" THEN '{g}' END" for g, ts in fx.CUES.items()) + "], lambda t: t IS NOT NULL), ';') AS cue_groups FROM rt")
def d_groups_in_text(spark, sf_dir):
    return fx.roundtrips(spark, sf_dir).select("doc_id", F.array_join(cues.groups_in(F.col("original_text"), fx.CUES), ";").alias("cue_groups"))


# E: semi-structured


@query(f"WITH {fx.RT}, {fx.ANN} SELECT doc_id, (pos - 1) // 3 AS ann_idx, span, label, 'permit' AS decision FROM spans")
def e_annotations(spark, sf_dir):
    return fx.spans(spark, sf_dir).select("doc_id", "ann_idx", "span", "label", "decision")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS parse_ok FROM events")
def e_tolerant_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", jsonish.parse(F.col("props")))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.col("v").isNotNull().alias("parse_ok"))


@query(f"WITH {fx.RT}, {fx.ANN} SELECT doc_id, (pos - 1) // 3 AS ann_idx, span, label, 'permit' AS decision FROM spans")
def e_bracket_syntax(spark, sf_dir):
    s = fx.spans(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ann_idx", "span", "label"))), lambda a: F.concat(a["span"], F.lit(" ["), a["label"], F.lit("] (permit)"))), " ").alias("compact"))
    return s.select("doc_id", F.posexplode(jsonish.bracketed(F.col("compact"))).alias("ann_idx", "a")).select("doc_id", "ann_idx", "a.*")


@query("SELECT count(*) AS n, count(DISTINCT source) AS sources FROM documents")
def a_scan_audit(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def a_last_write_wins(spark, sf_dir):
    from spanloom.sources.files import last_write_wins

    return last_write_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"))


@query("""WITH l AS (SELECT page_id, unnest(str_split(html, '><')) AS line, generate_subscripts(str_split(html, '><'), 1) AS n FROM pages), g AS (SELECT *, sum((line LIKE 'p%')::INT) OVER (PARTITION BY page_id ORDER BY n) AS island FROM l)
SELECT page_id, island, count(*) AS n_lines, min(n) AS first_line FROM g GROUP BY ALL""")
def e_line_islands(spark, sf_dir):
    l = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "><")).alias("n", "line")).withColumn("n", F.col("n") + 1)  # noqa: E741
    return relational.islands(l, ["page_id"], ["n"], F.col("line").startswith("p")).groupBy("page_id", "island").agg(F.count("*").alias("n_lines"), F.min("n").alias("first_line"))


# F, U9: pair metrics


@query(f"""WITH {fx.RT}, c AS (SELECT doc_id, score, tk, rk, list_distinct(tk) AS o, list_distinct(rk) AS r, list_distinct(list_filter(tk, lambda t: length(t) > 1 AND NOT list_contains({STOP_SQL}, t))) AS co, list_distinct(list_filter(rk, lambda t: length(t) > 1 AND NOT list_contains({STOP_SQL}, t))) AS cr,
 list_distinct(list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) AS bo, list_distinct(list_transform(range(1, len(rk)), lambda i: rk[i] || ' ' || rk[i + 1])) AS br FROM rt), m AS (
 SELECT *, CASE WHEN len(o) = 0 AND len(r) = 0 THEN 1.0 ELSE len(list_intersect(o, r)) / len(list_distinct(list_concat(o, r))) END AS token_jaccard,
 CASE WHEN len(co) = 0 THEN 1.0 ELSE len(list_intersect(co, cr)) / len(co) END AS content_recall, CASE WHEN len(cr) = 0 THEN 1.0 ELSE len(list_intersect(co, cr)) / len(cr) END AS content_precision,
 CASE WHEN len(bo) = 0 THEN 1.0 ELSE len(list_intersect(bo, br)) / len(bo) END AS bigram_recall, len(rk) / greatest(1, len(tk)) AS length_ratio FROM c)
SELECT doc_id, round(token_jaccard, 6) AS token_jaccard, round(content_recall, 6) AS content_recall, round(content_precision, 6) AS content_precision, round(CASE WHEN content_recall + content_precision = 0 THEN 0 ELSE 2 * content_precision * content_recall / (content_precision + content_recall) END, 6) AS content_f1,
 round(bigram_recall, 6) AS bigram_recall, round(length_ratio, 6) AS length_ratio, score >= 0.8 AND (content_recall < 0.65 OR bigram_recall < 0.35 OR (len(tk) >= 12 AND length_ratio < 0.55)) AS high_score_low_coverage, len(list_filter(co, lambda t: NOT list_contains(cr, t))) AS n_missing FROM m""")
def f_pair_metrics(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir)
    c = rt.select("doc_id", "score", "tk", "rk", text.content(F.col("tk")).alias("co"), text.content(F.col("rk")).alias("cr"), text.bigrams(F.col("tk")).alias("bo"), text.bigrams(F.col("rk")).alias("br"))
    m = c.select("*", sets.jaccard(F.col("tk"), F.col("rk")).alias("token_jaccard"), sets.recall(F.col("co"), F.col("cr")).alias("content_recall"), sets.recall(F.col("cr"), F.col("co")).alias("content_precision"), sets.recall(F.col("bo"), F.col("br")).alias("bigram_recall"), (F.size("rk") / F.greatest(F.lit(1), F.size("tk"))).alias("length_ratio"))
    low = (F.col("content_recall") < 0.65) | (F.col("bigram_recall") < 0.35) | ((F.size("tk") >= 12) & (F.col("length_ratio") < 0.55))
    rounded = [r6(F.col(x)).alias(x) for x in ("token_jaccard", "content_recall", "content_precision", "bigram_recall", "length_ratio")]
    return m.select("doc_id", *rounded, r6(sets.f1(F.col("content_precision"), F.col("content_recall"))).alias("content_f1"), ((F.col("score") >= 0.8) & low).alias("high_score_low_coverage"), F.size(sets.missing(F.col("co"), F.col("cr"))).alias("n_missing"))


@query("WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9'']+')) AS t FROM documents), c AS (SELECT lang, t, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM c) SELECT lang, round(-sum(p * log2(p)), 6) AS entropy FROM s GROUP BY lang")
def f_entropy(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("lang", F.explode(text.tokens(F.col("text"))).alias("t")).groupBy("lang", "t").agg(F.count("*").alias("n"))
    total = c.groupBy("lang").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return c.join(total, "lang").groupBy("lang").agg(r6(-F.sum(p * F.log2(p))).alias("entropy"))


@query("WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL), s AS (SELECT vec_id, label, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS sim FROM e JOIN c USING (label, i) GROUP BY ALL) SELECT label, arg_max(vec_id, {'s': round(sim, 9), 'v': -vec_id}) AS exemplar, round(max(sim), 6) AS similarity FROM s GROUP BY label")
def f_centroid_exemplars(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    flat = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    centroid = flat.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m")))["m"].alias("centroid"))
    s = e.join(centroid, "label").select("label", "vec_id", sets.cosine(F.col("embedding"), F.col("centroid")).alias("sim"))
    return s.groupBy("label").agg(F.max_by("vec_id", F.struct(F.round("sim", 9), -F.col("vec_id"))).alias("exemplar"), r6(F.max("sim")).alias("similarity"))


# G: spans


@query(f"WITH {fx.RT}, {fx.ANN}, s AS (SELECT doc_id, (pos - 1) // 3 AS ann_idx, span, CASE WHEN span = '' THEN -1 ELSE strpos(original_text, span) - 1 END AS span_start, original_text FROM spans) SELECT doc_id, ann_idx, span_start, CASE WHEN span_start < 0 THEN -1 ELSE span_start + length(span) END AS span_end FROM s")
def g_locate(spark, sf_dir):
    s = fx.spans(spark, sf_dir).select("doc_id", "ann_idx", "span", spans.located(F.col("original_text"), F.col("span")).alias("span_start"))
    return s.select("doc_id", "ann_idx", "span_start", F.when(F.col("span_start") < 0, -1).otherwise(F.col("span_start") + F.length("span")).alias("span_end"))


@query(f"""WITH {fx.RT}, {fx.ANN}, s AS (SELECT doc_id, (pos - 1) // 3 AS k, strpos(original_text, span) - 1 AS a0, strpos(original_text, span) - 1 + length(span) AS a1 FROM spans WHERE span <> '')
SELECT a.doc_id, a.k AS k1, b.k AS k2, a.a0 = b.a0 AND a.a1 = b.a1 AS same, greatest(a.a0, b.a0) < least(a.a1, b.a1) AS overlap, greatest(a.a0, b.a0) < least(a.a1, b.a1) AND ((a.a0 <= b.a0 AND a.a1 >= b.a1) OR (b.a0 <= a.a0 AND b.a1 >= a.a1)) AND NOT (a.a0 = b.a0 AND a.a1 = b.a1) AS nested
FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.k < b.k""")
def g_interval_relations(spark, sf_dir):
    s = fx.spans(spark, sf_dir).filter("span <> ''").select("doc_id", F.col("ann_idx").alias("k"), spans.located(F.col("original_text"), F.col("span")).alias("a0"), F.length("span").alias("n")).withColumn("a1", F.col("a0") + F.col("n"))
    a, b = (s.select("doc_id", *(F.col(c).alias(f"{c}_{i}") for c in ("k", "a0", "a1"))) for i in (1, 2))
    edges = [F.col(c) for c in ("a0_1", "a1_1", "a0_2", "a1_2")]
    return a.join(b, "doc_id").filter("k_1 < k_2").select("doc_id", F.col("k_1").alias("k1"), F.col("k_2").alias("k2"), spans.same(*edges).alias("same"), spans.overlap(*edges).alias("overlap"), spans.nested(*edges).alias("nested"))


# H: identifiers


# I: joins


@query("SELECT u.conv_id, u.turn, u.text AS original_text, a.text AS reconstructed_text FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def i_turn_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reconstructed_text"))
    return c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("original_text")).join(a, ["conv_id", "turn"])


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS has_forward, l.doc_id IS NOT NULL AS has_backward FROM (SELECT doc_id FROM documents WHERE lang <> 'fr') d FULL JOIN labels l ON d.doc_id = l.doc_id")
def i_outer_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("lang <> 'fr'").select("doc_id", F.lit(True).alias("f"))
    l = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("b"))  # noqa: E741
    return d.join(l, "doc_id", "full_outer").select("doc_id", F.coalesce("f", F.lit(False)).alias("has_forward"), F.coalesce("b", F.lit(False)).alias("has_backward"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def i_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query(f"""WITH {fx.RT}, w AS (SELECT llm, form_id, condition, avg(score) AS s FROM rt GROUP BY ALL) SELECT a.llm, a.condition AS cond_a, b.condition AS cond_b, count(*) AS n, round(avg(a.s - b.s), 6) AS mean_delta, round(avg((a.s > b.s)::INT), 6) AS win_rate, round(avg((a.s = b.s)::INT), 6) AS tie_rate FROM w a JOIN w b ON a.llm = b.llm AND a.form_id = b.form_id AND a.condition < b.condition GROUP BY ALL""")
def i_condition_differences(spark, sf_dir):
    w = fx.roundtrips(spark, sf_dir).groupBy("llm", "form_id", "condition").agg(F.avg("score").alias("s"))
    a, b = (w.select("llm", "form_id", F.col("condition").alias(f"cond_{x}"), F.col("s").alias(f"s_{x}")) for x in "ab")
    d = F.col("s_a") - F.col("s_b")
    return a.join(b, ["llm", "form_id"]).filter("cond_a < cond_b").groupBy("llm", "cond_a", "cond_b").agg(F.count("*").alias("n"), r6(F.avg(d)).alias("mean_delta"), r6(F.avg((F.col("s_a") > F.col("s_b")).cast("int"))).alias("win_rate"), r6(F.avg((F.col("s_a") == F.col("s_b")).cast("int"))).alias("tie_rate"))


# J: aggregates


@query(f"WITH {fx.RT} SELECT condition, llm, information_model, count(*) AS n, count(DISTINCT form_id) AS n_forms, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score, round(avg((score >= 0.8)::INT), 6) AS share_80, count(meaning_preserved) AS n_labelled FROM rt GROUP BY ALL")
def j_condition_summary(spark, sf_dir):
    return fx.roundtrips(spark, sf_dir).groupBy("condition", "llm", "information_model").agg(F.count("*").alias("n"), F.countDistinct("form_id").alias("n_forms"), r6(F.avg("score")).alias("mean_score"), r6(F.median("score")).alias("median_score"), r6(F.avg((F.col("score") >= 0.8).cast("int"))).alias("share_80"), F.count("meaning_preserved").alias("n_labelled"))


@query("SELECT c_mktsegment, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS nations FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def j_distinct_sets(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"))


@query("WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9'']+')) AS t FROM documents), c AS (SELECT source, t, count(*) AS n FROM w GROUP BY ALL) SELECT source, t, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, t) <= 5")
def j_most_common(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("source", F.explode(text.tokens(F.col("text"))).alias("t"))
    return relational.most_common(w, ["source"], "t", 5)


@query(f"WITH {fx.RT} SELECT * FROM (SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM rt UNION ALL SELECT 'forms', count(DISTINCT form_id) FROM rt UNION ALL SELECT 'labelled', count(meaning_preserved) FROM rt)")
def j_audit(spark, sf_dir):
    return relational.audit(fx.roundtrips(spark, sf_dir), {"rows": F.count("*"), "forms": F.countDistinct("form_id"), "labelled": F.count("meaning_preserved")})


# K, L, M


@query("SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 10")
def k_top_per_group(spark, sf_dir):
    order = [F.desc("n_chars"), F.asc("doc_id")]
    return relational.ranked(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], order).filter("rank <= 10")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def k_global_top(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("SELECT arg_min(doc_id, doc_id) AS doc_id, text FROM documents GROUP BY text")
def l_first_distinct(spark, sf_dir):
    return relational.first_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], F.col("doc_id"))


@query("SELECT doc_id, lang, NULL::INT AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def l_union_by_name(spark, sf_dir):
    return relational.union_all(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query("SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source")
def m_pivot_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@query("SELECT doc_id, name, value FROM (SELECT doc_id, quality, toxic FROM labels) UNPIVOT (value FOR name IN (quality, toxic))")
def m_unpivot(spark, sf_dir):
    return table(spark, sf_dir, "labels").unpivot(["doc_id"], ["quality", "toxic"], "name", "value").filter("value IS NOT NULL")


# N: graphs


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS k FROM lineitem), n AS (SELECT count(DISTINCT g) AS n FROM b), s AS (SELECT k, count(*) AS c FROM b GROUP BY k), p AS (SELECT x.k AS a, y.k AS b, count(*) AS support FROM b x JOIN b y ON x.g = y.g AND x.k < y.k GROUP BY ALL)
SELECT a, b, support, round(support * n / (s1.c * s2.c), 6) AS lift, round(log2(support * n / (s1.c * s2.c)), 6) AS pmi FROM p JOIN s s1 ON s1.k = a JOIN s s2 ON s2.k = b, n""")
def n_cooccurrence(spark, sf_dir):
    g = graph.cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")
    return g.select("a", "b", "support", r6("lift").alias("lift"), r6("pmi").alias("pmi"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 7 AND x.c_nationkey % 3 = y.c_nationkey % 3), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT c_custkey AS node, c_custkey AS seen FROM customer UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen) SELECT node, min(seen) AS cluster FROM r GROUP BY node""")
def n_components(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    x, y = c.select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("na")), c.select(F.col("c_custkey").alias("b"), F.col("c_nationkey").alias("nb"))
    edges = x.join(y, F.expr("b = a + 7 AND na % 3 = nb % 3")).select("a", "b")
    return graph.clusters(c.select(F.col("c_custkey").alias("node")), edges)


@query("WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9'']+')) AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.2")
def i_similar_sets(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", text.tokens(F.col("text")).alias("t"))
    return graph.similar_sets(b, "item_id", "t", 0.2).select("a", "b", r6("jaccard").alias("jaccard"))


# O, P: retrieval, evaluation, folds


_TFIDF = "w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM benchmark), g AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT item_id, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT item_id) AS n FROM tf), x AS (SELECT item_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term), n), v AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w FROM x)"


@query(f"WITH {_TFIDF} SELECT item_id, term, round(w, 6) AS w FROM v")
def o_tfidf(spark, sf_dir):
    return retrieval.weights(retrieval.grams(table(spark, sf_dir, "benchmark"), "item_id", "text"), "item_id").select("item_id", "term", r6("w").alias("w"))


@query(f"WITH {_TFIDF}, s AS (SELECT a.item_id AS query_id, b.item_id AS item_id, round(sum(a.w * b.w), 9) AS score FROM v a JOIN v b ON a.term = b.term AND a.item_id <> b.item_id GROUP BY ALL) SELECT query_id, item_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 3")
def o_retrieve(spark, sf_dir):
    v = retrieval.weights(retrieval.grams(table(spark, sf_dir, "benchmark"), "item_id", "text"), "item_id")
    s = retrieval.similarities(v.withColumnRenamed("item_id", "query_id"), "query_id", v, "item_id").filter("query_id <> item_id").withColumn("score", F.round("score", 9))
    return retrieval.retrieve(s, "query_id", "item_id", 3).withColumn("score", r6("score"))


@query()
def o_char_grams(spark, sf_dir):
    return retrieval.weights(retrieval.char_grams(table(spark, sf_dir, "benchmark"), "item_id", "text"), "item_id").select("item_id", "term", r6("w").alias("w"))


@query(f"""WITH {fx.RT}, s AS (SELECT llm, score AS s, meaning_preserved AS y FROM rt WHERE meaning_preserved IS NOT NULL), k AS (SELECT llm, sum(y) AS p, sum(1 - y) AS q, sum(CASE WHEN s >= 0.5 THEN y ELSE 0 END) AS tp, sum(CASE WHEN s >= 0.5 THEN 1 - y ELSE 0 END) AS fp FROM s GROUP BY llm),
 a AS (SELECT x.llm, sum(CASE WHEN x.s > z.s THEN 1 WHEN x.s = z.s THEN 0.5 ELSE 0 END) AS area FROM s x JOIN s z ON x.llm = z.llm AND x.y = 1 AND z.y = 0 GROUP BY x.llm)
SELECT llm, p + q AS n, round((tp + q - fp) / (p + q), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(p, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(tp + fp + p, 0), 0), 6) AS f1, round(area / nullif(p * q, 0), 6) AS auroc FROM k LEFT JOIN a USING (llm)""")
def o_metrics(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir).select("llm", "score", F.col("meaning_preserved").alias("y"))
    m = evaluation.metrics(rt, ["llm"])
    return m.select("llm", "n", *(r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auroc")))


@query(f"WITH {fx.RT} SELECT condition, threshold, count(*) AS n, round(avg((score >= threshold)::INT), 6) AS retained FROM rt, (SELECT unnest([0.5, 0.7, 0.8, 0.9])::DOUBLE AS threshold) GROUP BY ALL")
def o_retention(spark, sf_dir):
    return evaluation.retention(fx.roundtrips(spark, sf_dir), ["condition"]).withColumn("retained", r6("retained"))


@query("SELECT doc_id, substr(sha1(doc_id::VARCHAR || '||' || source), 1, 12) AS stable_id, ('0x' || substr(sha1(source), 1, 8))::BIGINT % 4 AS fold FROM documents")
def p_hash_folds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.stable_id(F.col("doc_id").cast("string"), F.col("source")).alias("stable_id"), evaluation.hash_fold(F.col("source"), 4).alias("fold"))


@query("SELECT source, 'fold_0' || ((row_number() OVER (ORDER BY substr(sha1(source || '|7'), 1, 12), source) - 1) % 4) AS fold_id FROM (SELECT DISTINCT source FROM documents)")
def p_round_robin_folds(spark, sf_dir):
    return evaluation.round_robin_folds(table(spark, sf_dir, "documents"), "source", 4, 7)


@query()
def o_cross_validated_models(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir).filter("meaning_preserved IS NOT NULL")
    f = rt.select("doc_id", "llm", "information_model", "form_id", F.col("meaning_preserved").alias("y"), F.size("tk").cast("double").alias("n_tokens"), sets.jaccard(F.col("tk"), F.col("rk")).alias("jaccard"), F.col("score").alias("given")).cache()
    out = []
    for name, (train, test) in evaluation.splits(f, "y", evaluation.hash_fold(F.col("form_id"), 2), []).items():
        scored = evaluation.fit_score(train, test, "lr", ["n_tokens", "jaccard", "given"], ["information_model"])
        out.append(evaluation.metrics(scored.withColumn("split", F.lit(name)), ["split"]))
    return relational.union_all(*out)


# N, O, U: clusters, senses, cards and schemas


def _mentions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.concat(F.lit("E"), "label").alias("element"), "embedding", (F.col("vec_id") % 3 != 0).alias("positive"), F.concat(F.lit("role"), F.col("vec_id") % 2).alias("role"), F.concat(F.lit("head"), F.col("vec_id") % 5).alias("head"))


@query()
def o_average_linkage(spark, sf_dir):
    return senses.linked(_mentions(spark, sf_dir), "element", "vec_id", "embedding", 0.6)


@query()
def n_senses(spark, sf_dir):
    return senses.senses(_mentions(spark, sf_dir), "element", "vec_id", "embedding", "positive", "role", "head", 5, 0.6).select("element", "vec_id", "sense")


_NODES = "nodes AS (SELECT information_model AS cluster_id, label AS node, information_model || doc_id % 2 AS source_model, llm, form_id AS form, count(*) AS n_mentions FROM spans GROUP BY ALL)"


@query(f"""WITH {fx.RT}, {fx.ANN}, {_NODES}, u AS (SELECT DISTINCT cluster_id, node FROM nodes),
edges AS (SELECT x.cluster_id AS c, CASE (length(x.node) + length(y.node)) % 3 WHEN 0 THEN 'near_equivalent' WHEN 1 THEN 'unsafe_to_merge' ELSE 'complementary' END AS relationship
          FROM u x JOIN u y ON x.cluster_id = y.cluster_id AND x.node < y.node),
s AS (SELECT cluster_id, sum(n_mentions)::BIGINT AS support, count(DISTINCT source_model) AS ns, count(DISTINCT llm) AS nl, count(DISTINCT form) AS nf, count(DISTINCT node) AS n_nodes FROM nodes GROUP BY ALL),
e AS (SELECT c, count(*) FILTER (relationship = 'near_equivalent') AS n_equivalent, count(*) FILTER (relationship = 'unsafe_to_merge') AS n_unsafe FROM edges GROUP BY c)
SELECT cluster_id, support, n_nodes, coalesce(n_equivalent, 0) AS n_equivalent, coalesce(n_unsafe, 0) AS n_unsafe,
  concat_ws(';', CASE WHEN ns <= 1 THEN 'single_source_model_support' END, CASE WHEN nl <= 1 THEN 'single_llm_support' END, CASE WHEN nf <= 1 THEN 'single_form_support' END,
    CASE WHEN coalesce(n_unsafe, 0) > 0 THEN 'unsafe_merge_warning_present' END, CASE WHEN coalesce(n_equivalent, 0) = 0 THEN 'singleton_or_no_explicit_equivalence_edge' END, CASE WHEN n_nodes > 5 THEN 'large_seed_cluster_review_boundary' END) AS flags
FROM s LEFT JOIN e ON cluster_id = c""")
def n_cards(spark, sf_dir):
    s = fx.spans(spark, sf_dir)
    nodes = s.groupBy(F.col("information_model").alias("cluster_id"), F.col("label").alias("node"), F.concat("information_model", F.col("doc_id") % 2).alias("source_model"), "llm", F.col("form_id").alias("form")).agg(F.count("*").alias("n_mentions"))
    pairs = relational.pairs_within(nodes, "cluster_id", "node").select("a", "b", ((F.length("a") + F.length("b")) % 3).alias("r"))
    edges = pairs.select("a", "b", F.when(F.col("r") == 0, "near_equivalent").when(F.col("r") == 1, "unsafe_to_merge").otherwise("complementary").alias("relationship"))
    size = lambda c: F.size(c).cast("long")
    return schema.cards(nodes, edges, "cluster_id").select("cluster_id", "support", size("nodes").alias("n_nodes"), size("equivalence_edges").alias("n_equivalent"), size("unsafe_merge_warnings").alias("n_unsafe"), F.array_join("quality_flags", ";").alias("flags"))


@query(f"""WITH {fx.RT}, w AS (SELECT form_id, unnest(tk) AS t FROM rt), c AS (SELECT form_id, t, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT form_id, t, row_number() OVER (PARTITION BY form_id ORDER BY n DESC, t) AS r FROM c)
SELECT form_id, coalesce(string_agg(t, ' ' ORDER BY t) FILTER (r <= 10 AND t NOT IN ({", ".join(f"'{x}'" for x in schema.ARTIFACTS)})), '') AS terms FROM k GROUP BY form_id""")
def u_term_profile(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir).withColumn("suggested", F.lit(None).cast("array<string>"))
    found = schema.term_profile(rt, "form_id", "suggested", "tk", 10).join(rt.filter(F.size("tk") > 0).select("form_id").distinct(), "form_id", "left_semi")
    return found.select("form_id", F.array_join("terms", " ").alias("terms"))


@query(f"WITH {fx.RT} SELECT information_model, llm, count(*) AS n_rows, count(*) FILTER (length(original_text) > 0) AS n_eligible, count(*) FILTER (meaning_preserved = 1) AS n_preserved, count(*) FILTER (meaning_preserved = 0) AS n_not_preserved, round(avg(len(tk)), 6) AS mean_tokens FROM rt GROUP BY ALL")
def u_corpus_summary(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir)
    return rt.groupBy("information_model", "llm").agg(F.count("*").alias("n_rows"), F.count_if(F.length("original_text") > 0).alias("n_eligible"), F.count_if(F.col("meaning_preserved") == 1).alias("n_preserved"), F.count_if(F.col("meaning_preserved") == 0).alias("n_not_preserved"), r6(F.avg(F.size("tk"))).alias("mean_tokens"))


@query(f"WITH {fx.RT} SELECT form_id, llm, round(avg(score) FILTER (condition = 'cond0'), 6) AS cond0, round(avg(score) FILTER (condition = 'cond1'), 6) AS cond1, round(avg(score) FILTER (condition = 'cond2'), 6) AS cond2 FROM rt GROUP BY ALL")
def u_wide_conditions(spark, sf_dir):
    names = ["cond0", "cond1", "cond2"]
    wide = fx.roundtrips(spark, sf_dir).groupBy("form_id", "llm").pivot("condition", names).agg(F.avg("score"))
    return wide.select("form_id", "llm", *(r6(F.col(c)).alias(c) for c in names))


_FIELDS = "f AS (SELECT upper(lang) AS fold, 'E' || length(source) AS field_id, source, count(*) AS n FROM documents GROUP BY ALL)"


@query(f"WITH {_FIELDS} SELECT fold, count(*) AS n_fields, CAST(to_json({{'schema_id': fold, 'fields': list({{'field_id': field_id, 'name': source, 'n': n}} ORDER BY n DESC, source)}}) AS VARCHAR) AS schema_json FROM f GROUP BY fold")
def u_schema_emission(spark, sf_dir):
    f = table(spark, sf_dir, "documents").groupBy(F.upper("lang").alias("fold"), F.concat(F.lit("E"), F.length("source")).alias("field_id"), "source").agg(F.count("*").alias("n"))
    return schema.emit(f, "fold", [-F.col("n"), F.col("source")], field_id=F.col("field_id"), name=F.col("source"), n=F.col("n"))


@query(r"""SELECT doc_id, array_to_string(list_distinct_ordered, ';') AS ids, array_to_string(list_filter(['ICO', 'DUO', 'ODRL', 'FHIR', 'FHIR_Consent'], lambda m: regexp_matches(prose, '(?i)\b' || m || '\b')), ';') AS models,
  (doc_id % 3 = 0 OR doc_id % 4 = 1) AS allowed
FROM (SELECT *, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS list_distinct_ordered
      FROM (SELECT *, ['C' || (doc_id % 50 + 100)] || regexp_extract_all(prose, '(?:C\d{3,}|SG[_-]?\d+|field[_-]?\d+|cluster[_-]?\d+)', 0, 'i') AS ids
            FROM (SELECT doc_id, 'see C' || (doc_id % 100 + 100) || ', field_' || (doc_id % 7) || CASE doc_id % 4 WHEN 0 THEN ' of ico' WHEN 1 THEN ' of FHIR_Consent' ELSE ' (DUO)' END AS prose FROM documents)))""")
def u_field_evidence(spark, sf_dir):
    part = F.when(F.col("doc_id") % 4 == 0, " of ico").when(F.col("doc_id") % 4 == 1, " of FHIR_Consent").otherwise(" (DUO)")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("see C"), F.col("doc_id") % 100 + 100, F.lit(", field_"), F.col("doc_id") % 7, part).alias("prose"))
    allowed = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("m1 "), F.lit("x")))
    given = F.array(F.concat(F.lit("C"), F.col("doc_id") % 50 + 100))
    return d.select("doc_id", F.array_join(schema.evidence_ids([given], [F.col("prose")]), ";").alias("ids"), F.array_join(schema.models_named(F.col("prose")), ";").alias("models"), schema.modifier_allowed(allowed, F.concat(F.lit("m"), F.col("doc_id") % 4)).alias("allowed"))


@query(f"""WITH {fx.RT}, r AS (SELECT condition, llm, doc_id, score,
  row_number() OVER (PARTITION BY condition, llm ORDER BY score DESC, doc_id) AS b, row_number() OVER (PARTITION BY condition, llm ORDER BY score, doc_id) AS w,
  row_number() OVER (PARTITION BY condition, llm ORDER BY doc_id % 6 DESC, (doc_id % 11) / 10.0, doc_id) AS e FROM rt)
SELECT condition, llm, doc_id, score FROM r WHERE b <= 3 OR w <= 3 OR e <= 3""")
def k_review_mixture(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir).select("condition", "llm", "doc_id", "score", (F.col("doc_id") % 6).alias("errors"), ((F.col("doc_id") % 11) / 10).alias("recall"))
    return relational.review_mixture(rt, ["condition", "llm"], 9, "score", "errors", "recall", "doc_id").select("condition", "llm", "doc_id", "score")


@query(f"WITH {fx.RT} SELECT min(doc_id) AS doc_id, form_id, original_text, CASE WHEN length(form_id) % 2 = 0 THEN 'heldout' ELSE 'training' END AS eval_split FROM rt WHERE length(original_text) > 0 GROUP BY form_id, original_text")
def u_evaluation_rows(spark, sf_dir):
    rt = fx.roundtrips(spark, sf_dir)
    held = rt.select("form_id").distinct().filter(F.length("form_id") % 2 == 0)
    return schema.evaluation_rows(rt, held, "form_id", "original_text", "doc_id").select("doc_id", "form_id", "original_text", "eval_split")


def flagship(spark, sf_dir):
    return f_pair_metrics(spark, sf_dir)


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
