"""Evidence on pairs of senses: what their mentions share, how a pair is typed, clusters of equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import sets, spans, text
from spanloom.operators.graph import clusters
from spanloom.operators.relational import numbered

# Thresholds of the typing cascade.
THRESHOLDS = {
    "same": 2, "overlap": 2, "nested": 2, "positive": 2, "forms": 1, "sentences": 1, "complementary": 2, "proximity": 0.75, "near_embedding": 0.72, "near_span": 0.70, "unsafe_similarity": 0.68,
    "unsafe_entropy": 1.25, "negative_ratio": 0.50, "confidence": 0.55,
}
_KEEP = ("sense", "span_start", "span_end", "information_model", "llm", "validity")
_USED = ("sense", "span", "span_start", "span_end", "token_start", "token_end", "information_model", "llm", "validity", "form", "role_signature")
COUNTERS = (
    "same_span_count", "overlap_count", "nested_span_count", "same_sentence_cooccurrence", "within_information_model_cooccurrence", "cross_information_model_cooccurrence",
    "within_llm_cooccurrence", "cross_llm_cooccurrence", "same_model_same_llm", "cross_model_same_llm", "same_model_cross_llm", "cross_model_cross_llm",
)


def pair_features(mentions: DataFrame, context: str = "context_id", order: str = "provenance") -> DataFrame:
    """sense_1 < sense_2 with counts over pairs of mentions that share a sentence, supports, lift and
    PMI. Mentions that agree in sense, span, model, llm and validity count once a sentence. A
    sentence's mentions meet each other, no more: that is the quantity asked for."""
    first = F.min_by(F.struct(*_USED), F.col(order))
    m = mentions.groupBy(context, *(F.col(c).alias(f"_{c}") for c in _KEEP)).agg(first.alias("m")).select(F.col(context).alias("context"), "m")
    positive = mentions.filter("validity = 'valid_positive'")
    per = positive.groupBy(F.col("sense").alias("s")).agg(F.countDistinct(context).alias("n"))
    x, y = m.select("context", F.col("m").alias("a")), m.select("context", F.col("m").alias("b"))
    p = x.join(y, "context").filter(F.col("a.sense") < F.col("b.sense"))
    at = lambda c: [F.col(f"a.{c}_start"), F.col(f"a.{c}_end"), F.col(f"b.{c}_start"), F.col(f"b.{c}_end")]
    model, llm = (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("information_model", "llm"))
    valid = lambda v: (F.col("a.validity") == v, F.col("b.validity") == v)
    both, some = valid("valid_positive"), valid("invalid_negative")
    terms = lambda c: F.array_distinct(text.term_tokens(F.col(f"{c}.span")))
    gap = spans.gap(*at("token")).cast("double")
    p = p.select(
        F.col("a.sense").alias("sense_1"), F.col("b.sense").alias("sense_2"), "context", (both[0] & both[1]).alias("both"), (some[0] | some[1]).alias("some"), model.alias("model"), llm.alias("llm"),
        spans.same(*at("span")).alias("same"), spans.overlap(*at("span")).alias("over"), spans.nested(*at("span")).alias("nest"), gap.alias("gap"), spans.proximity(gap).alias("near"),
        sets.jaccard_or_zero(terms("a"), terms("b")).alias("alike"), F.col("a.form").alias("form_a"),
        F.array("a.information_model", "b.information_model").alias("models"), F.array("a.llm", "b.llm").alias("llms"),
    )
    n = lambda c: F.count_if(F.col("both") & c)
    mo, ll = F.col("model"), F.col("llm")
    counts = [F.col("same"), F.col("over"), F.col("nest"), F.lit(True), mo, ~mo, ll, ~ll, mo & ll, ~mo & ll, mo & ~ll, ~mo & ~ll]
    when = lambda c: F.when(F.col("both"), F.col(c))
    members = lambda c: F.size(F.filter(F.array_distinct(F.flatten(F.collect_set(when(c)))), lambda v: v != ""))
    g = p.groupBy("sense_1", "sense_2").agg(
        *(n(c).alias(name) for name, c in zip(COUNTERS, counts, strict=True)), F.count_if("some").alias("negative_failure_support"),
        F.round(F.coalesce(F.sum(when("near")), F.lit(0.0)), 6).alias("proximity_weighted_cooccurrence"), F.avg(when("gap")).alias("mean_token_distance"),
        F.round(F.coalesce(F.avg(when("alike")), F.lit(0.0)), 6).alias("span_text_similarity"), F.countDistinct(when("form_a")).alias("form_support"), F.countDistinct(when("context")).alias("sentence_support"),
        members("models").alias("cross_model_support"), members("llms").alias("cross_llm_support"),
    )
    total = positive.agg(F.greatest(F.lit(1), F.countDistinct(context)).alias("n_contexts"))
    g = g.join(per.select(F.col("s").alias("sense_1"), F.col("n").alias("n_1")), "sense_1", "left").join(per.select(F.col("s").alias("sense_2"), F.col("n").alias("n_2")), "sense_2", "left").crossJoin(total)  # of one row
    lift = F.coalesce(F.try_divide(F.col("same_sentence_cooccurrence") * F.col("n_contexts"), F.col("n_1") * F.col("n_2")), F.lit(0.0))
    g = g.withColumn("_lift", lift).withColumn("lift", F.round("_lift", 6)).withColumn("pmi", F.round(F.when(F.col("_lift") > 0, F.log2("_lift")).otherwise(0.0), 6))
    return g.withColumn("positive_preserved_support", F.col("same_sentence_cooccurrence")).drop("_lift", "n_1", "n_2", "n_contexts")


def with_nodes(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds roles, role entropies and embedding similarity of both senses (nodes: sense, role, entropy, embedding)."""
    of = lambda i: nodes.select(F.col("sense").alias(f"sense_{i}"), F.col("role").alias(f"dominant_role_{i}"), F.col("entropy").alias(f"role_entropy_{i}"), F.col("embedding").alias(f"_e{i}"))
    g = features.join(of(1), "sense_1").join(of(2), "sense_2")
    alike = F.round(F.coalesce(sets.dot(F.col("_e1"), F.col("_e2")), F.lit(0.0)), 6)
    return g.withColumn("embedding_similarity", alike).drop("_e1", "_e2")


def dense(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """All pairs of senses, those without evidence with zeros: as many rows as pairs, by demand."""
    a, b = nodes.select(F.col("sense").alias("sense_1")), nodes.select(F.col("sense").alias("sense_2"))
    return a.join(b, F.col("sense_1") < F.col("sense_2")).join(features, ["sense_1", "sense_2"], "left").na.fill(0)


def typed(features: DataFrame, t: dict | None = None) -> DataFrame:
    """Adds relationship_type, relationship_confidence and relationship_reason."""
    t = {**THRESHOLDS, **(t or {})}
    c = F.col
    same, over, nest, cooc, emb, alike, near = (c(x) for x in ("same_span_count", "overlap_count", "nested_span_count", "same_sentence_cooccurrence", "embedding_similarity", "span_text_similarity", "proximity_weighted_cooccurrence"))
    pos, neg, forms, sentences = (c(x) for x in ("positive_preserved_support", "negative_failure_support", "form_support", "sentence_support"))
    r1, r2 = c("dominant_role_1"), c("dominant_role_2")
    known = lambda r: ~r.isin("", "other")
    compatible, conflict = (r1 == r2) & known(r1), (r1 != r2) & known(r1) & known(r2)
    high = F.greatest("role_entropy_1", "role_entropy_2") >= t["unsafe_entropy"]
    ratio = neg / F.greatest(F.lit(1), pos + neg)
    recurrent = (forms >= t["forms"]) & (sentences >= t["sentences"]) & (pos >= t["positive"])
    cross = (c("cross_model_support") > 1) | (c("cross_llm_support") > 1)
    mergeable = recurrent & (ratio <= t["negative_ratio"]) & compatible
    also = lambda first: F.concat(F.lit(first), F.when(cross, "; cross-information-model or cross-LLM support").otherwise(""))
    cases: list[tuple[Column, str, Column]] = [
        (conflict & ((same > 0) | (over > 0) | (emb >= t["unsafe_similarity"])), "unsafe_to_merge", F.lit("high overlap/similarity with conflicting actor/action/resource/purpose/time/privacy roles")),
        (high & (emb >= t["unsafe_similarity"]) & ~compatible, "unsafe_to_merge", F.lit("broad/high-entropy role signature with high semantic similarity")),
        (mergeable & (same >= t["same"]) & (emb >= t["near_embedding"]), "near_equivalent", also("recurrent same-span evidence, compatible roles, and high embedding similarity")),
        (mergeable & (over >= t["overlap"]) & (alike >= t["near_span"]), "near_equivalent", also("recurrent overlapping spans with high lexical similarity and compatible roles")),
        ((nest >= t["nested"]) & recurrent, "broader_narrower", F.lit("recurrent nested spans / lexical containment pattern")),
        ((cooc >= t["complementary"]) & (near >= t["proximity"]) & (over == 0) & conflict, "complementary", F.lit("recurrent proximal co-occurrence with distinct local roles")),
        (cooc > 0, "related_context_only", F.lit("same-sentence context without enough merge evidence")),
    ]
    kind, reason = F.lit("related_context_only"), F.lit("insufficient recurrence/co-occurrence/overlap evidence")
    for condition, name, why in reversed(cases):
        kind, reason = F.when(condition, name).otherwise(kind), F.when(condition, why).otherwise(reason)
    num = lambda x: x.cast("int")
    capped = lambda x: F.least(F.lit(1.0), x)
    confidence = (
        F.when(c("relationship_type") == "near_equivalent", capped(0.20 * same + 0.15 * over + 0.22 * emb + 0.18 * alike + 0.08 * num(cross) + 0.05 * F.log1p(forms) + 0.05 * F.log1p(sentences) - 0.15 * ratio))
        .when(c("relationship_type") == "broader_narrower", capped(nest / F.greatest(F.lit(1), pos) + 0.20 * alike + 0.05 * F.log1p(forms)))
        .when(c("relationship_type") == "complementary", capped(near / F.greatest(F.lit(1), cooc) + 0.1 * F.log1p(cooc) + 0.05 * num(conflict)))
        .when(c("relationship_type") == "unsafe_to_merge", capped(0.5 + 0.25 * emb + 0.1 * F.log1p(over + same) + 0.1 * num(high))).otherwise(0.0)
    )
    typed_ = features.withColumn("relationship_type", kind).withColumn("relationship_reason", reason)
    return typed_.withColumns({"relationship_confidence": F.round(confidence, 6), "negative_support_ratio": F.round(ratio, 6), "recurrence_condition_met": recurrent, "cross_model_or_llm_support_met": cross})


def equivalence_clusters(nodes: DataFrame, relationships: DataFrame, t: dict | None = None) -> DataFrame:
    """sense, seed_cluster_id: components of trusted near-equivalent pairs, numbered by falling size,
    then by their least sense; single senses keep a cluster of their own."""
    t = {**THRESHOLDS, **(t or {})}
    use = relationships.filter((F.col("relationship_type") == "near_equivalent") & (F.col("relationship_confidence") >= t["confidence"]) & (F.col("positive_preserved_support") >= t["positive"]))
    found = clusters(nodes.select(F.col("sense").alias("node")), use.select(F.col("sense_1").alias("a"), F.col("sense_2").alias("b")))
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n"))
    named = numbered(sizes, [F.desc("n"), F.asc("cluster")]).select("cluster", F.concat(F.lit("SC"), F.lpad((F.col("number") + 1).cast("string"), 3, "0")).alias("seed_cluster_id"))
    return found.join(named, "cluster").select(F.col("node").alias("sense"), "seed_cluster_id")


def relation_rows(relationships: DataFrame, senses: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Relationships that touch any of the senses, each once."""
    r = relationships.filter(F.col("relationship_type").isin(kinds)) if kinds else relationships
    ends = r.select("*", F.explode(F.array("sense_1", "sense_2")).alias("_end"))
    return ends.join(senses.select(F.col("sense").alias("_end")).distinct(), "_end", "left_semi").drop("_end").distinct()


def recurrence(seed_clusters: DataFrame, terms: int = 6) -> DataFrame:
    """Signature (first suggested terms) with the folds it occurs in and its mentions."""
    signature = F.array_join(F.slice("suggested_terms", 1, terms), " | ")
    return seed_clusters.groupBy(signature.alias("signature_terms")).agg(F.countDistinct("fold_id").alias("n_folds"), F.array_join(F.array_sort(F.collect_set("fold_id")), ",").alias("folds"), F.sum("n_mentions").alias("total_mentions"))
