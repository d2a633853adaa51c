"""Relational parts of reviews: samples, previews, dictionaries, highlighted texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import spans, text
from spanloom.operators.relational import union_all


def fixed_sample(df: DataFrame, key: str, n: int, seed: int, at_least: dict[str, int]) -> DataFrame:
    """n keys in order of a seeded hash, of those that have at least so many distinct values of columns."""
    able = df.groupBy(key).agg(*(F.countDistinct(c).alias(f"_{c}") for c in at_least))
    for c, least in at_least.items():
        able = able.filter(F.col(f"_{c}") >= least)
    order = F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return able.select(key).orderBy(order, key).limit(n)


def examples(df: DataFrame, sample: DataFrame, key: str, condition: str, order: str) -> DataFrame:
    """A sample's rows over all conditions, one row a key and condition (the first in order)."""
    first = df.join(sample, key, "left_semi").groupBy(key, condition).agg(F.min_by(F.struct(*(c for c in df.columns if c not in (key, condition))), order).alias("_r"))
    return first.select(key, condition, "_r.*")


def preview(annotations: Column, n: int = 12) -> Column:
    """The first annotations as one line each."""
    line = lambda a: F.concat(a["span"], F.lit(" -> "), a["label"], F.when(a["decision"] != "", F.concat(F.lit(" ("), a["decision"], F.lit(")"))).otherwise(""))
    return F.array_join(F.transform(F.slice(annotations, 1, n), line), "\n")


def escaped(x: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def highlighted(body: Column, chosen: Column) -> Column:
    """A text as HTML with its chosen spans (start, end, label; greedy, longest first) marked."""
    picked = spans.greedy(chosen)
    piece = lambda a, b: escaped(F.substring(body, a + 1, F.greatest(b - a, F.lit(0))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("html"))
    mark = lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["html"], piece(s["at"], x["start"]), F.lit('<mark title="'), escaped(x["label"]), F.lit('">'), piece(x["start"], x["end"]), F.lit("</mark>")).alias("html"))
    return F.aggregate(picked, begin, mark, lambda s: F.concat(s["html"], piece(s["at"], F.length(body))))


def badge(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.when(value.isNull(), "n/a").otherwise(F.format_number(value, 2)))


def wrapped(x: Column, width: int) -> Column:
    """Line ends instead of the last blank before each width characters."""
    return F.regexp_replace(F.regexp_replace(x, rf"(.{{1,{width}}})(?:\s+|$)", "$1\n"), r"\n$", "")


def dictionaries(manual: DataFrame, induced: DataFrame, consensus: DataFrame) -> DataFrame:
    """Fields of hand-made, fold-wise induced and consensus schemas as one table, repeats dropped."""
    named = lambda df, kind: df.withColumn("dictionary", F.lit(kind))
    return union_all(named(manual, "manual"), named(induced, "induced"), named(consensus, "consensus")).distinct()


def review_rows(df: DataFrame, by: list[str], order: list, per_group: int, most: int) -> DataFrame:
    """The first rows of each group, and of those at most so many in all, dealt evenly over groups."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= per_group)
    return ranked.orderBy("_r", *by, *order).limit(most).drop("_r")


def cluster_summary(members: DataFrame, cluster: str, label: str, listed: dict[str, str]) -> DataFrame:
    """cluster, size, preserved_rate, and for each listed column its values with their counts, joined."""
    out = members.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(label).alias("preserved_rate"))
    for column, name in listed.items():
        counts = members.filter(F.col(column).isNotNull()).groupBy(cluster, column).agg(F.count("*").alias("k"))
        one = counts.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), F.col(column).cast("string").alias("v")))), lambda x: F.concat(x["v"], F.lit(":"), -x["o"])), ";").alias(name))
        out = out.join(one, cluster, "left")
    return out


def artifact(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("artifact", F.lit(name))


def relabelled(df: DataFrame, **constants: str) -> DataFrame:
    """Rows with constant columns set anew."""
    return df.withColumns({c: F.lit(v) for c, v in constants.items()})


def path_list(given: str) -> list[str]:
    """Paths of a list split at commas and line ends, in order, each once."""
    return list(dict.fromkeys(p.strip() for part in given.splitlines() for p in part.split(",") if p.strip()))


def compact(x: Column, n: int) -> Column:
    return text.shortened(text.collapsed(x), n)
