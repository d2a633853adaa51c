"""Graph mining over co-occurring elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.components import connected_components
from spanloom.operators.relational import pairs_within


def cooccurrence(df: DataFrame, group: str, key: str, min_support: int = 1) -> DataFrame:
    """a, b, support, pmi, lift: groups that hold both, against those that hold either."""
    rows = df.select(group, key).dropna().distinct()
    n = rows.select(group).distinct().agg(F.count("*").alias("n_groups"))
    single = rows.groupBy(key).agg(F.count("*").alias("n"))
    both = pairs_within(df, group, key).groupBy("a", "b").agg(F.count("*").alias("support")).filter(F.col("support") >= min_support)
    joined = both.join(single.select(F.col(key).alias("a"), F.col("n").alias("n_a")), "a").join(single.select(F.col(key).alias("b"), F.col("n").alias("n_b")), "b").crossJoin(F.broadcast(n))  # one row
    lift = F.col("support") * F.col("n_groups") / (F.col("n_a") * F.col("n_b"))
    return joined.select("a", "b", "support", lift.alias("lift"), F.when(lift > 0, F.log2(lift)).otherwise(0.0).alias("pmi"))


def clusters(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """node, cluster: components of edges (a, b); nodes without an edge are their own cluster."""
    found = connected_components(edges)
    return nodes.select(F.col(node).alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def tier(folds: Column, support: Column, models: Column, core=(3, 80), extension=(2, 40), least_models: int = 2) -> Column:
    """core and extension: least folds and least support of each."""
    reaches = lambda least: (folds >= least[0]) & (support >= least[1]) & (models >= least_models)
    return F.when(reaches(core), "core_candidate").when(reaches(extension), "extension_candidate").otherwise("audit_only")


def similar_sets(df: DataFrame, key: str, terms: str, threshold: float, carry: list[str] = (), meets: Column | None = None) -> DataFrame:
    """a, b, jaccard: pairs of keys a < b whose term sets have a Jaccard similarity of at least threshold.

    An index on the first terms of each set in order of rarity meets every such pair. What cannot be
    similar is left out within the index join: by the sets' sizes, by how many terms are left from the common one on, and by
    meets, a condition on the columns carry of both sides (as {name}_a and {name}_b). The rest is verified."""
    sets = df.select(key, *carry, F.array_distinct(terms).alias("t")).filter(F.size("t") > 0)
    words = sets.select(key, F.explode("t").alias("w"))
    rarity = words.groupBy("w").agg(F.count("*").alias("df"))
    ordered = words.join(rarity, "w").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    size = F.size("o")
    first = F.slice("o", F.lit(1), (size - F.ceil(F.lit(threshold) * size - 1e-9) + 1).cast("int"))["w"]
    index = ordered.join(sets.select(key, *carry), key).select(key, *carry, size.alias("n"), F.posexplode(first).alias("at", "w"))
    side = lambda s: index.select("w", F.col(key).alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "at", *carry)))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    possible = F.least(n_a - F.col("at_a"), n_b - F.col("at_b")) >= threshold / (1 + threshold) * (n_a + n_b) - 1e-9
    near = (F.col("a") < F.col("b")) & (F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b) - 1e-9) & possible
    met = side("a").join(side("b"), "w").filter(near if meets is None else near & meets).select("a", "b").distinct()
    common = F.size(F.array_intersect("ta", "tb"))
    both = met.join(sets.select(F.col(key).alias("a"), F.col("t").alias("ta")), "a").join(sets.select(F.col(key).alias("b"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", (common / (F.size("ta") + F.size("tb") - common)).alias("jaccard")).filter(F.col("jaccard") >= threshold)
