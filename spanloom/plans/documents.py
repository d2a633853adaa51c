"""Registered queries over nested JSON that the given tables make, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import diagnostics, evidence
from spanloom.plans import fixtures as fx
from spanloom.plans.catalog import query
from spanloom.session import table

_LINES = "li AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS flag, l_linestatus AS status, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) - 1 AS j FROM lineitem)"


def _orders(spark, sf_dir, line):
    """o_custkey, o_orderkey and its lines, each as line says, in order."""
    li = table(spark, sf_dir, "lineitem")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")]
    lines = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order))), line).alias("lines"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").drop("l_orderkey").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))


@query(f"""WITH {_LINES}, o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT DISTINCT c, '' AS path, '' AS id, 'customer ' || c AS label, 'customer ' || c AS span FROM o
UNION ALL SELECT c, 'orders[' || i || ']', k::VARCHAR, k::VARCHAR, k::VARCHAR FROM o UNION ALL SELECT c, 'orders[' || i || '].lines[' || j || ']', '', flag || ' of ' || n, flag || ' of ' || n FROM o JOIN li USING (k)
UNION ALL SELECT c, 'orders[' || i || '].lines[' || j || '].more.parts[1]', 'E' || n, status, 'E' || n FROM o JOIN li USING (k)""")
def e_json_walk(spark, sf_dir):
    line = lambda x: F.struct(F.concat(x["l_returnflag"], F.lit(" of "), x["l_linenumber"]).alias("Span"), F.struct(F.array(F.lit("plain"), F.to_json(F.struct(F.lit("[text]").alias("id"))), F.lit(None).cast("string")).alias("texts"), F.array(F.struct(F.lit("").alias("label"), F.lit(None).cast("string").alias("Code")), F.struct(x["l_linestatus"].alias("label"), F.concat(F.lit("E"), x["l_linenumber"]).alias("Code"))).alias("parts")).alias("more"))
    o = _orders(spark, sf_dir, line)
    one = F.struct("o_orderkey", F.struct(F.lit(True).alias("open"), F.col("o_orderkey").alias("id"), "lines").alias("o"))
    c = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["o"]).alias("orders"))
    raw = F.to_json(F.struct(F.concat(F.lit("customer "), "o_custkey").alias("name"), "orders"))
    found = evidence.units_beside(c, raw, "o_custkey").select(F.col("o_custkey").alias("c"), F.explode("units").alias("u"))
    return found.select("c", "u.path", F.col("u.source_element_id").alias("id"), "u.label", "u.span").withColumn("span", F.when(F.col("id").startswith("E"), F.col("id")).otherwise(F.col("span")))


@query(f"""WITH {_LINES}, w AS (SELECT k, flag AS v, 2 * j AS p FROM li UNION ALL SELECT k, 'line ' || n || ' is ' || status, 2 * j + 1 FROM li), d AS (SELECT k, v, min(p) AS p FROM w GROUP BY ALL), f AS (SELECT k, string_agg(v, ';' ORDER BY p) AS found FROM d GROUP BY k)
SELECT o_orderkey, coalesce(found, '') AS found, found IS NOT NULL AS available FROM orders LEFT JOIN f ON k = o_orderkey""")
def e_nested_unmatched(spark, sf_dir):
    why = lambda x: F.concat(F.lit("line  "), x["l_linenumber"], F.lit(" is "), x["l_linestatus"])
    line = lambda x: F.struct(x["l_linenumber"].alias("n"), F.struct(x["l_returnflag"].alias("text"), F.array(F.lit(None).cast("string"), F.lit(" "), why(x)).alias("why")).alias("Unmatched Spans"))
    o = _orders(spark, sf_dir, line)
    docs = o.select("o_orderkey", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit("z").alias("other"), F.struct("lines").alias("deep"))), F.lit("\n```")).alias("raw"))
    u = diagnostics.unmatched_language(docs, "raw")
    return u.select("o_orderkey", F.array_join("unmatched_language", ";").alias("found"), F.col("unmatched_available").alias("available"))


@query(f"""WITH {_LINES}, e AS (SELECT k, 'annotations[' || j || ']' AS path, 'EN::E' || n AS union_element_id, flag AS span_text, '' AS decision_value, CASE WHEN n = 2 THEN 'sentence_level_decision' ELSE 'span_annotation' END AS element_kind FROM li
UNION ALL SELECT k, 'annotations[' || j || '].inner', 'DUO::DUO.decision', '', lower(status), 'sentence_level_decision' FROM li) SELECT k, path, union_element_id, span_text, decision_value, element_kind FROM e""")
def u_mapping_records(spark, sf_dir):
    inner = lambda x: F.struct(F.lit("").alias("value"), F.lit("DUO::DUO.decision").alias("union_element_id"), F.lower(x["l_linestatus"]).alias("decision"))
    line = lambda x: F.struct(F.lit(None).cast("string").alias("span_text"), x["l_returnflag"].alias("evidence_span_text"), F.concat(F.lit("EN::E"), x["l_linenumber"]).alias("union_element_id"), inner(x).alias("inner"), F.array(F.struct(F.lit("").alias("union_element_id"))).alias("rest"))
    o = _orders(spark, sf_dir, line)
    rows = o.select(F.col("o_orderkey").alias("k"), F.to_json(F.struct(F.col("lines").alias("annotations"))).alias("mapping"))
    inv = fx.inventory(spark, sf_dir).withColumn("element_scope", F.when(F.col("source_order") == 2, "Sentence").otherwise("span"))
    return diagnostics.mapping_records(rows, "mapping", inv).select("k", "path", "union_element_id", "span_text", "decision_value", "element_kind")
