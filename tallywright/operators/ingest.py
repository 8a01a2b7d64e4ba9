"""From files and rows to documents with fields."""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".csv", ".xlsx", ".docx")
LOW_CONFIDENCE, KEY_FIELD, LARGEST = 0.85, 0.60, 50 << 20
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Built-in number formats that show a day.
DATE_FORMATS = (14, 15, 16, 17, 22)
FIELDS = "array<struct<field_id:string,label:string,value:string,confidence:double>>"


def supported(found: DataFrame) -> DataFrame:
    """(path, name, suffix, length, content, error) of binary files of a supported kind; what is too large has an error and no content."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = found.withColumn("name", name).withColumn("suffix", F.lower(F.regexp_extract("name", r"\.[^.]+$", 0))).where(F.col("suffix").isin(*SUFFIXES))
    large = F.col("length") > LARGEST
    return rows.select("path", "name", "suffix", "length", F.when(~large, F.col("content")).alias("content"), F.when(large, "larger than 50 MB").alias("error"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Supported files below a path."""
    return supported(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A sheet as strings: trimmed headers and cells, empty ones null, columns without a header left out."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, encoding="UTF-8", escape='"')
    named = [(c, c.strip().lstrip("﻿")) for c in raw.columns if c.strip() and not (c.startswith("_c") and c[2:].isdigit())]
    return raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(n) for c, n in named])


def unpivot(rows: DataFrame, id_col: str) -> DataFrame:
    """(document_id, fields): every other column of a row as a field, in order, read for sure."""
    others = [c for c in rows.columns if c != id_col]
    made = [F.struct(F.lit(f"field-{n + 1}").alias("field_id"), F.lit(c).alias("label"), F.col(c).cast("string").alias("value"), F.lit(1.0).alias("confidence")) for n, c in enumerate(others)]
    return rows.select(F.col(id_col).alias("document_id"), F.array(*made).cast(FIELDS).alias("fields"))


def row_id(stem: Column, number: Column) -> Column:
    return F.concat(stem, F.format_string("-row-%04d", number))


def adapted(fields: Column) -> Column:
    """Fields with ids by place where they have none, and blank labels as such."""
    return F.transform(fields, lambda f, i: F.struct(
        F.coalesce(f["field_id"], F.concat(F.lit("field-"), i.cast("string"))).alias("field_id"), F.coalesce(f["label"], F.lit("")).alias("label"), f["value"].alias("value"), f["confidence"].alias("confidence")
    ))


def build(documents: DataFrame) -> DataFrame:
    """Documents with the mean confidence of their fields, whether it is low, and the fields read worst."""
    known = F.filter("fields", lambda f: f["confidence"].isNotNull())
    mean = F.round(F.aggregate(known, F.lit(0.0), lambda s, f: s + f["confidence"]) / F.size(known), 4)
    weak = F.transform(F.filter(known, lambda f: f["confidence"] < KEY_FIELD), lambda f: f["field_id"])
    scored = documents.withColumn("extraction_confidence", F.when(F.size(known) > 0, mean).otherwise(0.0))
    return scored.withColumn("low_confidence", F.col("extraction_confidence") < LOW_CONFIDENCE).withColumn("low_confidence_fields", weak)


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows a day."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId", 0)): f.get("formatCode", "") for f in root.iter(f"{_SHEET}numFmt")}
    bare = {i: re.sub(r'"[^"]*"|\\[[^\\]]*\\]|\\\\.', "", code).lower() for i, code in own.items()}
    shown = {i for i, code in bare.items() if "y" in code or "d" in code} | set(DATE_FORMATS)
    styles = root.find(f"{_SHEET}cellXfs")
    return [int(x.get("numFmtId", 0)) in shown for x in styles] if styles is not None else []


def _day(serial: str, from_1904: bool) -> str:
    """A day's number as ISO text, with the time if there is one; serial numbers count a 29th of February 1900 that never was."""
    number = float(serial)
    start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30 if number >= 60 else 31)
    moment = start + dt.timedelta(days=number)
    rounded = moment + dt.timedelta(microseconds=500_000)
    moment = rounded.replace(microsecond=0)
    return moment.date().isoformat() if moment.time() == dt.time() else moment.isoformat(sep=" ")


def xlsx_rows(content: bytes) -> list[dict[str, str | None]]:
    """The first sheet's rows by header; rows without any value are skipped, and days are given as such."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in ET.fromstring(book.read("xl/sharedStrings.xml"))]
        days = _date_styles(book)
        settings = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_SHEET}workbookPr") if "xl/workbook.xml" in names else None
        from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        sheet = min(n for n in names if n.startswith("xl/worksheets/sheet"))
        table = []
        for row in ET.fromstring(book.read(sheet)).iter(f"{_SHEET}row"):
            cells: dict[int, str | None] = {}
            for cell in row.iter(f"{_SHEET}c"):
                column = 0
                for letter in filter(str.isalpha, cell.get("r", "A")):
                    column = column * 26 + ord(letter) - 64
                value, kind, style = cell.find(f"{_SHEET}v"), cell.get("t", "n"), int(cell.get("s", 0))
                text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")) if kind == "inlineStr" else value.text if value is not None else None
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                elif kind == "n" and text is not None and style < len(days) and days[style]:
                    text = _day(text, from_1904)
                cells[column] = text
            table.append(cells)
    heads = {c: (v or "").strip() for c, v in table[0].items()} if table else {}
    clean = lambda v: (v.strip() or None) if v is not None else None
    return [{h: clean(cells.get(c)) for c, h in heads.items() if h} for cells in table[1:] if any(v is not None for v in cells.values())]


def csv_rows(content: bytes) -> list[dict[str, str | None]]:
    """A file's rows by header, trimmed, blank cells null; columns without a header are left out, and rows without any cell."""
    rows = list(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")))
    heads = [h.strip() for h in rows[0]] if rows else []
    return [{h: (c.strip() or None) for h, c in zip_longest(heads, row[: len(heads)], fillvalue="") if h} for row in rows[1:] if row]


def docx_text(content: bytes) -> str:
    """Paragraphs, then table rows with cells two blanks apart."""
    with zipfile.ZipFile(io.BytesIO(content)) as doc:
        body = ET.fromstring(doc.read("word/document.xml")).find(f"{_WORD}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t"))
    lines = [said(p) for p in body.findall(f"{_WORD}p")]
    lines += ["  ".join(said(c) for c in row.findall(f"{_WORD}tc")) for row in body.iter(f"{_WORD}tr")]
    return "\n".join(lines)


SHEETS = {".csv": csv_rows, ".xlsx": xlsx_rows}


def ingest(found: DataFrame) -> DataFrame:
    """(document_id, source_name, fields, text, error) of sheets and texts: a document a row or file, and a row for each file that fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, suffix, content, error in zip(batch["name"], batch["suffix"], batch["content"], batch["error"]):
                stem, out = name.rsplit(".", 1)[0], []
                try:
                    if error:
                        raise ValueError(error)
                    if suffix in SHEETS:
                        for n, row in enumerate(SHEETS[suffix](bytes(content)), 1):
                            fields = [(f"field-{i}", h, v, 1.0) for i, (h, v) in enumerate(row.items(), 1)]
                            out.append((f"{stem}-row-{n:04d}", name, fields, None, None))
                    elif suffix == ".docx":
                        out.append((stem, name, [], docx_text(bytes(content)), None))
                    else:
                        raise ValueError(f"no reader for {suffix}")
                except Exception as problem:  # one bad file does not stop the others
                    out = [(None, name, None, None, f"{type(problem).__name__}: {problem}")]
                fields = ["field_id", "label", "value", "confidence"]
                rows = [(d, s, None if f is None else [dict(zip(fields, x)) for x in f], t, e) for d, s, f, t, e in out]
                yield pd.DataFrame(rows, columns=["document_id", "source_name", "fields", "text", "error"])

    return found.select("name", "suffix", "content", "error").mapInPandas(run, f"document_id string, source_name string, fields {FIELDS}, text string, error string")
