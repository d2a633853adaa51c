"""Workbook sink: tables as the sheets of one Excel file, written by a Spark data source.

Each task writes its rows as pieces of sheets beside the target; the commit joins the pieces into one archive
under another name and renames it, so a reader sees a whole file or none. A failed write deletes its pieces.
A sheet is a report: more rows than the format allows are an error.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from spanloom.operators.relational import numbered, union_all

FORMAT = "spanloom_workbook"
# The file format's limits and names.
MOST_ROWS, MOST_CELL, MOST_NAME = 1_048_575, 32_767, 31
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NO_XML = re.compile("[^\t\n\r -퟿-�\U00010000-\U0010ffff]")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def sheet_names(names: list[str]) -> list[str]:
    """Names as sheets may have them: without special signs, short, and different case aside."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", name).strip("'")[:MOST_NAME] or "Sheet"
        found, k = base, 1
        while found.lower() in {x.lower() for x in out}:
            k += 1
            found = f"{base[: MOST_NAME - len(str(k)) - 1]}_{k}"
        out.append(found)
    return out


def letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def row_xml(number: int, cells: list, numeric: list[bool], style: int = 0) -> str:
    """A row: numbers as such, other cells as inline texts, nulls left out."""
    out = []
    for i, cell in enumerate(cells):
        if cell is None:
            continue
        at = f'r="{letters(i)}{number}"' + (f' s="{style}"' if style else "")
        if numeric[i] and re.fullmatch(r"-?\d+(\.\d+)?([eE][-+]?\d+)?", cell):
            out.append(f"<c {at}><v>{cell}</v></c>")
        else:
            out.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(_NO_XML.sub(" ", cell)[:MOST_CELL])}</t></is></c>')
    return f'<row r="{number}">{"".join(out)}</row>'


@dataclass
class Pieces(WriterCommitMessage):
    """What a task has written: sheet, first row and file of each piece."""

    found: list[tuple[int, int, str]]


class WorkbookWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.sheets, self.overwrite = options["path"], json.loads(options["sheets"]), overwrite
        self.folder = f"{self.path}._pieces-{uuid.uuid4().hex}"
        # Made here and not by tasks: one that still runs when the job is given up can't make it anew.
        fs, folder = opened(self.folder)
        fs.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator) -> Pieces:
        found, sheet, out = [], None, None
        fs, folder = opened(self.folder)
        try:
            for row in iterator:
                if row["sheet"] != sheet:
                    if out:
                        out.close()
                    sheet = row["sheet"]
                    name = f"{folder}/{sheet}-{row['number']}-{uuid.uuid4().hex}.xml"
                    found.append((sheet, row["number"], name))
                    out = fs.open_output_stream(name)
                out.write(row_xml(row["number"] + 2, row["cells"], self.sheets[sheet]["numeric"]).encode())
        finally:
            if out:
                out.close()
        return Pieces(found)

    def commit(self, messages: list) -> None:
        fs, target = opened(self.path)
        _, folder = opened(self.folder)
        pieces = sorted(p for m in messages if m for p in m.found)
        done = f"{target}._{uuid.uuid4().hex}"
        if not self.overwrite and fs.get_file_info(target).type != pafs.FileType.NotFound:
            raise FileExistsError(self.path)
        with fs.open_output_stream(done) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in self.frame():
                z.writestr(name, content)
            for i, sheet in enumerate(self.sheets):
                with z.open(f"xl/worksheets/sheet{i + 1}.xml", "w", force_zip64=True) as out:
                    width = letters(max(len(sheet["columns"]) - 1, 0))
                    out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
                    out.write(row_xml(1, sheet["columns"], [False] * len(sheet["columns"]), 1).encode())
                    for _, _, piece in (p for p in pieces if p[0] == i):
                        with fs.open_input_stream(piece) as f:
                            while part := f.read(1 << 20):
                                out.write(part)
                    out.write(f'</sheetData><autoFilter ref="A1:{width}{sheet["rows"] + 1}"/></worksheet>'.encode())
        fs.move(done, target)
        fs.delete_dir(folder) if fs.get_file_info(folder).type != pafs.FileType.NotFound else None

    def abort(self, messages: list) -> None:
        fs, folder = opened(self.folder)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)

    def frame(self) -> list[tuple[str, str]]:
        """The archive's small parts."""
        n = range(1, len(self.sheets) + 1)
        sheets = "".join(f'<sheet name={quoteattr(s["name"])} sheetId="{i}" r:id="r{i}"/>' for i, s in zip(n, self.sheets, strict=True))
        links = "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + f'<Relationship Id="r{len(self.sheets) + 1}" Type="{_REL}/styles" Target="styles.xml"/>'
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i in n)
        return [
            ("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/>{kinds}</Types>'),
            ("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
            ("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>'),
            ("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>'),
            ("xl/styles.xml", f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'),
        ]


class WorkbookSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "sheet int, number long, cells array<string>"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(dict(self.options), overwrite)


def cells(df: DataFrame):
    """A row's cells as texts; lists, maps and records as JSON."""
    return F.array(*(F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`").cast("string") for f in df.schema.fields))


def write_workbook(spark: SparkSession, tables: dict[str, tuple[DataFrame, list]], path: str, overwrite: bool = True) -> None:
    """name -> (table, order of its rows) as the sheets of one Excel file at path, a folder's file in any store.

    Each sheet has a header row that stays in view, and filters. Tables without rows or columns are left out, as sheets
    with nothing to see; if none is left there is nothing to write and that is an error."""
    number = ("integer", "long", "short", "byte", "double", "float")
    sheets, parts = [], []
    for (name, (df, order)), sheet in zip(tables.items(), sheet_names(list(tables)), strict=True):
        n = df.limit(MOST_ROWS + 1).count() if df.columns else 0
        if n > MOST_ROWS:
            raise ValueError(f"{name} has more rows than a sheet can hold ({MOST_ROWS})")
        if n:
            kinds = [f.dataType.typeName() for f in df.schema.fields]
            rows = numbered(df.withColumn("_cells", cells(df)), order)
            parts.append(rows.select(F.lit(len(sheets)).alias("sheet"), "number", F.col("_cells").alias("cells")))
            sheets.append({"name": sheet, "columns": df.columns, "numeric": [k in number or k.startswith("decimal") for k in kinds], "rows": n})
    if not parts:
        raise ValueError("no table has rows")
    spark.dataSource.register(WorkbookSink)
    ready = union_all(*parts).repartitionByRange("sheet", "number").sortWithinPartitions("sheet", "number")
    ready.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("path", path).option("sheets", json.dumps(sheets)).save()
