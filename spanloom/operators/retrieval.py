"""TF-IDF weights and retrieval by term joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.relational import top_per_group


def words(text: Column) -> Column:
    """The words of two letters or more, in small letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def grams(df: DataFrame, key: str, text: str, bigrams: bool = True) -> DataFrame:
    """key, term for words of two letters or more and their bigrams."""
    rows = df.select(key, words(F.col(text) if isinstance(text, str) else text).alias("w"))
    pair = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    return rows.select(key, F.explode(F.concat("w", pair) if bigrams else F.col("w")).alias("term"))


def char_grams(df: DataFrame, key: str, text: str, low: int = 3, high: int = 5) -> DataFrame:
    """Character n-grams inside words that are padded with a blank on each side."""
    words = df.select(key, F.explode(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")).alias("w")).withColumn("w", F.concat(F.lit(" "), "w", F.lit(" ")))
    sized = words.select(key, "w", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("n")).filter(F.length("w") >= F.col("n"))
    return sized.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("n") + 1), lambda i: F.substr("w", i, F.col("n")))).alias("term"))


def weights(terms: DataFrame, key: str, documents: int | None = None) -> DataFrame:
    """key, term, w: tf * (ln((1 + n) / (1 + df)) + 1), of unit length for each key."""
    tf = terms.groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = tf.select(key).distinct().agg(F.count("*").alias("n")) if documents is None else terms.sparkSession.range(1).select(F.lit(documents).alias("n"))
    raw = tf.join(df, "term").crossJoin(F.broadcast(n)).select(key, "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("x"))  # one row
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("x") / F.col("norm")).alias("w"))


def similarities(queries: DataFrame, query: str, items: DataFrame, item: str) -> DataFrame:
    """Cosines of those query and item pairs that share a term."""
    q = queries.select(query, "term", F.col("w").alias("wq"))
    return q.join(items.select(item, "term", F.col("w").alias("wi")), "term").groupBy(query, item).agg(F.sum(F.col("wq") * F.col("wi")).alias("score"))


def retrieve(scored: DataFrame, query: str, item: str, k: int) -> DataFrame:
    return top_per_group(scored, [query], [F.desc("score"), F.asc(item)], k)
