"""Inventories read off prompt texts: element lines, wrapped definitions joined, split into their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import relational

# Lines that end a dictionary, lines that head one, and the identifiers of one model.
STOP_MARKERS = (
    "annotation rules", "output format", "use header", "quote fields", "do not include explanations", "each row represents", "input:", "now annotate", "this column must appear", "header name:", "allowed values:",
    "choose the value", "the value must be consistent",
)
HEADERS = r"^(?:element\s+id\s*(?:\||\s+)\s*definition|element\s+id|definition|use\s+only\s+these\s+labels:?\s*)$"
ODRL_IDS = ("Rule_TestSentence", "Permission", "Duty", "Prohibition", "Constraint", "Party", "Asset_DO", "Action_Verb")
SENTENCE_LEVEL = ("ODRL::Rule_TestSentence", "FHIR_Consent::Consent.provision.type")
MODELS = (("ico", "ICO"), ("duo", "DUO"), ("fhir_consent", "FHIR_Consent"), ("fhir", "FHIR_Consent"), ("odrl", "ODRL"))

_CURIE = r"[A-Za-z][A-Za-z0-9_.-]*:[A-Za-z0-9_.-]+"
_ODRL = "|".join(sorted(ODRL_IDS, key=len, reverse=True))
_STARTS = {"any": rf"^(?:Created\s*\({_CURIE}\)|{_CURIE})\s+\S+", "FHIR_Consent": r"^Consent(?:\.[A-Za-z0-9_-]+)*\b", "DUO": r"^[A-Z][A-Z0-9]{1,10}\s*\|\s*\S+", "ODRL": rf"^(?:{_ODRL})(?:\s|$)"}


def element_lines(prompts: DataFrame, key: str, model: str, body: str, stops=STOP_MARKERS) -> DataFrame:
    """key, model, source_order, line: each element with its continuation lines joined; source_order 0
    are lines before the first element. A dictionary begins after the first line that says to use
    only its labels, and ends at a stop marker."""
    lines = prompts.select(key, model, F.posexplode(F.split(text.plain_lines(F.col(body)), "\n")).alias("n", "line")).withColumn("line", text.collapsed(F.col("line")))
    low = F.lower("line")
    opens = F.contains(low, F.lit("use only")) & (F.contains(low, F.lit("label")) | F.contains(low, F.lit("element")))
    begin = lines.groupBy(key).agg(F.coalesce(F.min(F.when(opens, F.col("n"))), F.lit(-1)).alias("_begin"))
    inside = lines.join(begin, key).filter((F.col("n") > F.col("_begin")) & (F.col("line") != "") & ~low.rlike(HEADERS))
    stop = low.rlike("|".join(f"(?:{s})" for s in stops))
    end = inside.groupBy(key).agg(F.min(F.when(stop, F.col("n"))).alias("_end"))
    inside = inside.join(end, key).filter(F.col("_end").isNull() | (F.col("n") < F.col("_end")))
    bare = F.regexp_replace("line", "^[-•* ]+", "")
    starts = bare.rlike(_STARTS["any"])
    for name in ("FHIR_Consent", "DUO", "ODRL"):
        starts = starts | ((F.col(model) == name) & bare.rlike(_STARTS[name]))
    islands = relational.islands(inside, [key], ["n"], starts)
    return islands.groupBy(key, model, F.col("island").alias("source_order")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "line")))["line"], " ").alias("line"))


def elements(lines: DataFrame, model: str) -> DataFrame:
    """lines with source_element_id, _label, _definition, element_scope and union_element_id."""
    raw = F.replace("line", F.lit("***"), F.lit(" "))
    df = lines.filter("source_order > 0").withColumn("_l", text.collapsed(raw))
    forms = [(F.lit(True), r"^Created\s*\(([^)]+)\)\s+(.+)$"), (F.col(model) == "DUO", r"^([A-Z][A-Z0-9]{1,10})\s*\|\s*(.+)$"), (F.lit(True), rf"^({_CURIE})\s+(.+)$"), (F.col(model) == "FHIR_Consent", r"^(Consent(?:\.[A-Za-z0-9_-]+)*)\s+(.+)$"), (F.col(model) == "ODRL", rf"^({_ODRL})\s+(.+)$")]
    part = lambda i: F.coalesce(*(F.when(on, F.nullif(F.regexp_extract("_l", p, i), F.lit(""))) for on, p in forms), F.regexp_extract("_l", r"^(\S*)\s*(.*)$", i))
    df = df.withColumns({"source_element_id": F.trim(part(1)), "_rest": text.collapsed(part(2))})
    rest, uid = F.col("_rest"), F.col("source_element_id")
    ways = (r'^(.*?)["“](.+)["”]', r"^(.*?)\s+[–—-]\s+(.*)$", r"^(.{3,}?)\s+((?:A|An|The|a|an|the)\s+.*)$")
    label, definition = rest, F.lit("")
    for way in reversed(ways):
        hit = rest.rlike(way)
        label = F.when(hit, F.coalesce(F.nullif(text.collapsed(F.regexp_extract(rest, way, 1)), F.lit("")), uid)).otherwise(label)
        definition = F.when(hit, text.collapsed(F.regexp_extract(rest, way, 2))).otherwise(definition)
    own = F.col(model).isin("FHIR_Consent", "ODRL")
    union = F.concat(F.col(model), F.lit("::"), uid)
    return df.withColumns({
        "source_element_label": F.when((rest == "") | own, uid).otherwise(label), "source_element_definition": F.when(rest == "", "").when(own, rest).otherwise(definition),
        "union_element_id": union, "element_scope": F.when(union.isin(*SENTENCE_LEVEL), "sentence_level").otherwise("span"),
    }).drop("_l", "_rest")


def model_of_path(path: Column) -> Column:
    return text.first_contained(path, list(MODELS), "")


def candidates(scored: DataFrame, query: str, item: str, source: str, top: int, per_source: int) -> DataFrame:
    """query, item, source, score, rank: the best items of each query, and the best of each source
    model beside them, ranked again."""
    w = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), item)
    marked = scored.withColumn("_g", F.row_number().over(w(query))).withColumn("_s", F.row_number().over(w(query, source)))
    kept = marked.filter((F.col("_g") <= top) | (F.col("_s") <= per_source))
    return kept.withColumn("rank", F.row_number().over(w(query))).drop("_g", "_s")
