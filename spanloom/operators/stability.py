"""Fields of several folds that stand for the same thing: cross-fold similarity, groups, tiers, selection.

Fields with the same terms are one class and meet others once, whatever their number. Which class meets
which is found by an index on the rarest terms of each, and the side conditions (another fold,
near enough in size, far enough in front) are part of the index join, so pairs of one fold are never made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import relational
from spanloom.operators.components import connected_components
from spanloom.operators.graph import similar_sets, tier
from spanloom.session import stored

# Least Jaccard of two folds' term sets, least support of a field; folds, support and models of the tiers.
STABILITY, LEAST_SUPPORT = 0.45, 20
CORE, EXTENSION, LEAST_MODELS = (3, 80), (2, 40), 2
TOP_TERMS = 12


def classes(fields: DataFrame, fold: str, field: str, terms: str, support: str, least_support: int) -> DataFrame:
    """set, node (of the least fold and field), lo and hi (folds): a row for each set of terms of fields with enough support."""
    fit = fields.select(F.array_sort(F.array_distinct(terms)).alias("set"), F.col(fold).alias("f"), _node(fold, field).alias("node"), F.col(support).alias("s"))
    fit = fit.filter((F.col("s") >= least_support) & (F.size("set") > 0))
    return fit.groupBy("set").agg(F.min("node").alias("node"), F.min("f").alias("lo"), F.max("f").alias("hi"))


def _node(fold: str, field: str):
    return F.concat(F.col(fold), F.lit("::"), F.col(field))


def similar_fields(found: DataFrame, threshold: float) -> DataFrame:
    """a, b, jaccard: pairs of classes that are similar and do not both lie in one and the same fold."""
    apart = F.least("lo_a", "lo_b") != F.greatest("hi_a", "hi_b")
    return similar_sets(found, "node", "set", threshold, carry=["lo", "hi"], meets=apart)


def groups(fields: DataFrame, fold: str, field: str, terms: str, support: str, threshold: float = STABILITY, least_support: int = LEAST_SUPPORT) -> DataFrame:
    """fields with group, the least node (fold::field) of those that similar fields of other folds connect.

    Two classes that are similar connect all their fields if they hold two folds between them, since each
    field then has one of another fold to go by; so does one class that holds two folds. Fields of one fold with the
    same terms and nothing elsewhere stay apart, as do fields without support or terms."""
    found = stored(classes(fields, fold, field, terms, support, least_support), "fold-classes")
    joined = connected_components(similar_fields(found, threshold))
    homes = found.join(joined, "node", "left").select(F.col("set").alias("_set"), F.coalesce("component", F.when(F.col("lo") != F.col("hi"), F.col("node"))).alias("_home")).filter("_home IS NOT NULL")
    own = fields.withColumn("_own", F.when(F.col(support) >= least_support, F.array_sort(F.array_distinct(terms))))
    return own.join(homes, F.col("_own") == F.col("_set"), "left").withColumn("group", F.coalesce("_home", _node(fold, field))).drop("_own", "_set", "_home")


def stability(fields: DataFrame, fold: str = "fold", field: str = "candidate_field_id", terms: str = "terms", support: str = "n_positive_mentions", models: str = "n_source_models", threshold: float = STABILITY, least_support: int = LEAST_SUPPORT,
              core=CORE, extension=EXTENSION, least_models: int = LEAST_MODELS) -> tuple[DataFrame, DataFrame]:
    """The long table and the summary.

    long: fields with stability_group_id, selection_tier and what decides it: stability_n_folds,
    stability_total_support, stability_max_models, stability_top_terms (of most fields first, then by name).
    summary: a row a group with these, n_fields and folds. Groups are numbered by folds, then support (largest first), then
    their least node. Members of a group are rows of the long table, not a list in one row."""
    long = stored(groups(fields, fold, field, terms, support, threshold, least_support), "fold-groups")
    size = long.groupBy("group").agg(F.countDistinct(fold).alias("stability_n_folds"), F.sum(support).alias("stability_total_support"), F.max(models).alias("stability_max_models"), F.count("*").alias("n_fields"), F.array_sort(F.collect_set(fold)).alias("folds"))
    size = size.withColumn("selection_tier", tier(F.col("stability_n_folds"), F.col("stability_total_support"), F.col("stability_max_models"), core, extension, least_models))
    numbered = relational.numbered(size, [F.desc("stability_n_folds"), F.desc("stability_total_support"), F.asc("group")])
    named = numbered.withColumn("stability_group_id", F.format_string("SG%03d", F.col("number") + 1)).drop("number")
    often = relational.most_common(long.select("group", F.explode(F.array_distinct(terms)).alias("t")), ["group"], "t", TOP_TERMS)
    listed = often.groupBy("group").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "t")))["t"].alias("stability_top_terms"))
    summary = stored(named.join(listed, "group", "left").withColumn("stability_top_terms", F.coalesce("stability_top_terms", F.array().cast("array<string>"))), "fold-summary")
    return long.join(summary.drop("n_fields", "folds"), "group").drop("group"), summary.drop("group")


def selected(long: DataFrame, support: str = "n_positive_mentions", least_support: int = LEAST_SUPPORT) -> DataFrame:
    """The fields of the long table whose group is core or extension and that have support themselves."""
    return long.filter(F.col("selection_tier").isin("core_candidate", "extension_candidate") & (F.col(support) >= least_support))
