"""Deterministic round-trip, annotation and inventory views over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.session import spread, table

#: Terms that occur in the tables' invented prose; production dictionaries are read from files.
CUES = {
    "permission": ["is", "are", "of the"], "obligation": ["was", "be"], "prohibition": ["no ", "only"], "negation": ["no", "with"], "condition": ["when", "as", "at"], "exception": ["that"],
    "restriction": ["only", "this"], "withdrawal": ["from"], "action": ["on", "in"], "resource": ["the", "a"], "actor": ["it", "he"], "purpose": ["for", "to"],
}


def roundtrips(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.withColumn("tk", text.tokens(F.col("text"))).withColumn("rk", F.filter("tk", lambda x, i: i % 5 != F.col("doc_id") % 5))
    return d.select(
        "doc_id", F.concat(F.lit("rt"), F.col("doc_id")).alias("roundtrip_id"), F.array_join("tk", " ").alias("original_text"), F.array_join("rk", " ").alias("reconstructed_text"), "tk", "rk",
        F.concat(F.lit("llm"), F.col("doc_id") % 4).alias("llm"), F.col("lang").alias("information_model"), F.concat(F.lit("cond"), F.floor(F.col("doc_id") / 4) % 3).alias("condition"),
        F.col("source").alias("form_id"), F.col("quality").alias("meaning_preserved"), ((F.col("doc_id") * 37 % 100) / 100).alias("score"),
    )


RT = """rt AS (
  SELECT doc_id, 'rt' || doc_id AS roundtrip_id, array_to_string(tk, ' ') AS original_text, array_to_string(rk, ' ') AS reconstructed_text, tk, rk, 'llm' || (doc_id % 4) AS llm,
    lang AS information_model, 'cond' || (doc_id // 4 % 3) AS condition, source AS form_id, quality AS meaning_preserved, (doc_id * 37 % 100) / 100.0 AS score
  FROM (SELECT *, list_filter(tk, lambda x, i: (i - 1) % 5 <> doc_id % 5) AS rk
        FROM (SELECT d.*, l.quality, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9'']+') AS tk FROM documents d LEFT JOIN labels l USING (doc_id))))"""


def annotations(spark, sf_dir):
    """Three annotations a round trip, as the JSON text that a model would return."""
    rt = roundtrips(spark, sf_dir)
    word = lambda i: F.coalesce(F.try_element_at("tk", F.lit(i + 1)), F.lit(""))
    one = lambda i: F.struct(word(i).alias("span_text"), F.concat(F.upper("information_model"), F.lit("::E"), F.length(word(i))).alias("union_element_id"), F.lit("permit").alias("decision"))
    return rt.withColumn("raw_response", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(one(1), one(4), one(7)).alias("annotations"))), F.lit("\n```")))


ANN = """ann AS (
  SELECT *, unnest([1, 4, 7]) AS pos FROM rt), spans AS (
  SELECT * EXCLUDE (pos), pos, coalesce(tk[pos + 1], '') AS span, upper(information_model) || '::E' || length(coalesce(tk[pos + 1], '')) AS label FROM ann)"""


def spans(spark, sf_dir):
    """One row per annotation, parsed from the JSON text."""
    from spanloom.functions.jsonish import annotations as read
    from spanloom.functions.jsonish import parse

    a = annotations(spark, sf_dir)
    return a.select(*[c for c in a.columns if c != "raw_response"], F.posexplode(read(parse(F.col("raw_response")))).alias("ann_idx", "a")).select("*", "a.span", "a.label", "a.decision").drop("a")


def inventory(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select(F.upper("lang").alias("source_model")).distinct()
    e = langs.select("source_model", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("n"))
    name = F.concat(F.lit("E"), "n")
    return e.select(F.concat("source_model", F.lit("::"), name).alias("union_element_id"), "source_model", name.alias("source_element_id"), F.concat(F.lit("words of "), "n", F.lit(" letters")).alias("source_element_label"), F.col("n").alias("source_order"))


INV = "inv AS (SELECT m || '::E' || n AS union_element_id, m AS source_model, 'E' || n AS source_element_id, 'words of ' || n || ' letters' AS source_element_label, n AS source_order FROM (SELECT DISTINCT upper(lang) AS m FROM documents), range(1, 13) r(n))"
