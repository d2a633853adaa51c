"""Scans and sinks."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.jsonish import parse


def csv(spark: SparkSession, path, schema=None, blank_nulls: bool = False, multi_line: bool = True) -> DataFrame:
    """Rows of CSV files with a header; without a schema types are inferred. Files whose cells hold no
    line ends are read in parallel if multi_line is off."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", not blank_nulls).csv(path)
    return df.na.fill("") if blank_nulls else df


def tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV and JSON lines files as one table of texts: columns by name, _source_file of each row."""

    def one(path):
        if path.endswith((".json", ".jsonl")):
            df = spark.read.option("primitivesAsString", True).json(path)
        else:
            df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return df.withColumn("_source_file", F.col("_metadata.file_path"))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, paths))


def jsonl(spark: SparkSession, path, mode: str = "tolerant", limit: int | None = None) -> DataFrame:
    """_source_file, _line_no, record (variant), _jsonl_parse_error. Modes: tolerant, skip, strict.

    Line numbers are counted within each file: a block's lines are numbered where they are read, and
    the lines of the blocks before it, one row a block, are added. limit keeps the first lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("_source_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_source_file", "_block", "_first", before.alias("_before"))
    numbered = lines.join(blocks, ["_source_file", "_block"]).withColumn("_line_no", F.col("_id") - F.col("_first") + F.col("_before") + 1).filter(F.trim("value") != "")
    rows = numbered.select("_source_file", "_line_no", "value", F.try_parse_json("value").alias("record"))
    if limit is not None:
        rows = rows.orderBy("_source_file", "_line_no").limit(limit)
    bad = F.col("record").isNull()
    if mode == "skip":
        return rows.filter(~bad).drop("value").withColumn("_jsonl_parse_error", F.lit(False))
    if mode == "strict":
        return rows.select("_source_file", "_line_no", F.parse_json("value").alias("record"), F.lit(False).alias("_jsonl_parse_error"))
    return rows.withColumn("_jsonl_parse_error", bad).withColumn("value", F.when(bad, F.col("value")))


def last_write_wins(df: DataFrame, key: list[str], order) -> DataFrame:
    """The latest row of each key, by an aggregate that combines before it shuffles."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def fold_directories(spark: SparkSession, pattern: str) -> DataFrame:
    """CSV files under fold_*, the fold's name from the path."""
    return spark.read.option("header", True).csv(pattern).withColumn("fold_id", F.regexp_extract(F.col("_metadata.file_path"), "(fold_[0-9]+)", 1))


def whole_texts(spark: SparkSession, path, limit: int) -> DataFrame:
    """Guidance files: their text up to limit characters, and whether more was there."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return df.select("file", F.substring("value", 1, limit).alias("text"), F.length("value").alias("n_chars"), (F.length("value") > limit).alias("truncated"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def parsed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("parsed", parse(F.col(column))).withColumn("parse_ok", F.col("parsed").isNotNull())


def write_audit(summary: DataFrame, path: str) -> None:
    """A summary of a few rows as one JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def config(path: str, key: str) -> dict:
    """The settings of a model: the file's defaults, overridden by those under its name. JSON, or YAML
    where a reader is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            found = yaml.safe_load(f)
        else:
            found = json.load(f)
    models = found.get("models") or {}
    if key not in models:
        raise ValueError(f"no model {key}; known: {sorted(models)}")
    return {**(found.get("defaults") or {}), **models[key]}


def write_folds(df: DataFrame, fold: str, path: str) -> None:
    """A folder of rows for each fold."""
    df.write.partitionBy(fold).mode("overwrite").parquet(path)


_SHEETS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _cells(book: bytes, skip: str):
    """(sheet, row number, cells) of a workbook's sheets whose name does not match skip."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(book)) as z:
        read = lambda name: ElementTree.fromstring(z.read(name))
        names = set(z.namelist())
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{_SHEETS}t"))
        shared = [text(x) for x in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        for sheet in read("xl/workbook.xml").iter(f"{_SHEETS}sheet"):
            if skip and re.search(skip, sheet.get("name"), re.IGNORECASE):
                continue
            target = targets[sheet.get(f"{_LINKS}id")].lstrip("/")
            for row in read(target if target.startswith("xl/") else f"xl/{target}").iter(f"{_SHEETS}row"):
                cells: list[str] = []
                for c in row.iter(f"{_SHEETS}c"):
                    letters = "".join(x for x in c.get("r", "") if x.isalpha())
                    at = len(cells)
                    if letters:
                        at = 0
                        for x in letters:
                            at = at * 26 + ord(x) - 64
                        at -= 1
                    value, kind = c.find(f"{_SHEETS}v"), c.get("t")
                    said = text(c) if kind == "inlineStr" else "" if value is None else shared[int(value.text)] if kind == "s" else value.text
                    cells += [""] * (at - len(cells)) + [said or ""]
                yield sheet.get("name"), int(row.get("r", 0)), cells


def workbooks(spark: SparkSession, path, skip_sheets: str = "") -> DataFrame:
    """file, sheet, row, cells of Excel workbooks; a file is read in one piece, as zip archives are."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, *r) for r in _cells(content, skip_sheets)]
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, sheet string, row int, cells array<string>")


def with_headers(rows: DataFrame, known: list[str], least: int = 2) -> DataFrame:
    """Rows of workbooks below each sheet's header, as a map from header to cell. The header is the first
    row with at least so many known names."""
    named = F.size(F.array_intersect(F.transform("cells", lambda c: F.lower(F.trim(c))), F.array(*(F.lit(k.lower()) for k in known)))) >= least
    heads = rows.filter(named).groupBy("file", "sheet").agg(F.min("row").alias("_at"), F.min_by("cells", "row").alias("_head"))
    below = rows.join(heads, ["file", "sheet"]).filter(F.col("row") > F.col("_at"))
    pairs = F.filter(F.arrays_zip(F.col("_head").alias("k"), F.col("cells").alias("v")), lambda x: F.coalesce(F.trim(x["k"]), F.lit("")) != "")
    once = F.map_from_entries(F.filter(F.transform(pairs, lambda x: F.struct(F.trim(x["k"]).alias("k"), F.coalesce(x["v"], F.lit("")).alias("v"))), lambda x, i: F.array_position(F.transform(pairs, lambda y: F.trim(y["k"])), x["k"]) == i + 1))
    return below.select("file", "sheet", "row", once.alias("record"))


def write_markdown(summary: DataFrame, path: str, title: str) -> None:
    """A summary of a few rows as one Markdown file."""
    cells = F.concat_ws(" | ", *(F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("/")), F.lit("")) for c in summary.columns))
    head = summary.sparkSession.createDataFrame([(0, f"# {title}\n\n| " + " | ".join(summary.columns) + " |\n|" + "-|" * len(summary.columns))], "o int, line string")
    body = summary.select(F.lit(1).alias("o"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    head.unionByName(body).orderBy("o", "line").coalesce(1).select("line").write.mode("overwrite").text(path)


#: Files that one look-up may give.
MOST_FILES = 10_000


def resolve_paths(spark: SparkSession, given: str) -> list[str]:
    """Paths and patterns of a list split at commas and line ends, in order, each path once: a pattern (* ? [] {})
    becomes the files that match it, by name, in whatever store it is; what matches nothing stays as it is."""
    import re

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: list[str] = []
    for item in (p.strip() for p in re.split(r",(?![^{]*\})|[\r\n]+", given)):
        if item:
            at = jvm.org.apache.hadoop.fs.Path(item)
            found = at.getFileSystem(conf).globStatus(at) if re.search(r"[*?\[{]", item) else None
            out += sorted(f.getPath().toString() for f in found) if found else [item]
    return list(dict.fromkeys(out))


def found_below(spark: SparkSession, roots: list[str], pattern: str) -> list[str]:
    """Files at any depth below the roots whose name fits the pattern (* and ?), in order of roots, then path; roots
    that are not there are passed by."""
    import fnmatch

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: list[str] = []
    for root in roots:
        at = jvm.org.apache.hadoop.fs.Path(root)
        store, mine = at.getFileSystem(conf), []
        each = store.listFiles(at, True) if store.exists(at) else None
        while each is not None and each.hasNext():
            path = each.next().getPath()
            if fnmatch.fnmatchcase(path.getName(), pattern):
                mine.append(path.toString())
                if len(out) + len(mine) > MOST_FILES:
                    raise ValueError(f"more than {MOST_FILES} files fit {pattern}")
        out += sorted(mine)
    return list(dict.fromkeys(out))


def collected(spark: SparkSession, roots: list[str], patterns: dict[str, str]) -> dict[str, DataFrame]:
    """name -> all result tables below the roots whose file name fits its pattern, as one table: columns by name,
    texts, null where a file lacks one, artifact first (the file's path). Names without a file are left out.

    Files with the same header are one scan, so the plan grows with the kinds of tables, not with their number."""
    out = {}
    for name, pattern in patterns.items():
        paths = found_below(spark, roots, pattern)
        if paths:
            heads = spark.read.text(paths).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), "value", F.monotonically_increasing_id().alias("i"))
            first = heads.filter("b = 0").groupBy("f").agg(F.min_by("value", "i").alias("head"))
            alike: dict[str, list[str]] = {}
            for r in sorted(first.collect(), key=lambda r: r["f"]):  # a row a file, bounded above
                alike.setdefault(r["head"], []).append(r["f"])
            frames = [spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(same) for same in alike.values()]
            named = [df.select(F.col("_metadata.file_path").alias("artifact"), *df.columns) for df in frames]
            out[name] = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return out


def write_html(cards: DataFrame, html: str, order: list, path: str, title: str, style: str = "") -> None:
    """A report's cards, one element of HTML each, as one HTML document in order. A report is read by people: it is one file."""
    from spanloom.operators.relational import numbered

    spark = cards.sparkSession
    name = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    rows = numbered(cards, order).select(F.col("number").alias("o"), F.col(html).alias("line"))
    head = spark.createDataFrame([(-1, f'<!doctype html>\n<html><head><meta charset="utf-8"><title>{name}</title><style>{style}</style></head><body>\n<h1>{name}</h1>'), (1 << 62, "</body></html>")], "o long, line string")
    head.unionByName(rows).orderBy("o").coalesce(1).select("line").write.mode("overwrite").text(path)
