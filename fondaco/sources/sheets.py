"""Workbooks and recognition tables as rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes, sheet: int = 1) -> list[tuple[int, dict[str, str]]]:
    """(row number from 1, {heading: value}) of a workbook's sheet; the first row with a value has the headings. Blank rows are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    rows, heads = [], None
    for r in root.iter(f"{_MAIN}row"):
        cells = {}
        for c in r.findall(f"{_MAIN}c"):
            v, inline = c.find(f"{_MAIN}v"), c.find(f"{_MAIN}is")
            text = shared[int(v.text)] if c.get("t") == "s" and v is not None else "".join(t.text or "" for t in inline.iter(f"{_MAIN}t")) if inline is not None else (v.text or "") if v is not None else ""
            cells[re.match(r"[A-Z]+", c.get("r") or "A")[0]] = text.strip()
        if not any(cells.values()):
            continue
        if heads is None:
            heads = {k: v for k, v in cells.items() if v}
        else:
            rows.append((int(r.get("r") or 0), {h: cells.get(k, "") for k, h in heads.items()}))
    return rows


def read_workbooks(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(file, row_no, fields map<heading, value>) of every workbook of a folder; a file that can't be read gives one row with fields null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, c in zip(pdf["path"], pdf["content"]):
                try:
                    out += [(p, n, f) for n, f in sheet_rows(c, sheet)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    out.append((p, 0, None))
            yield pd.DataFrame(out, columns=["file", "row_no", "fields"])

    return files.mapInPandas(run, "file string, row_no long, fields map<string,string>")


def search_rows(queries: DataFrame, rows: DataFrame, surname: str, given: str, aliases: list[str] | None = None) -> DataFrame:
    """(query columns, file, row_no) of workbook rows that a query names: surname and given name alike, or a query of one name in either
    column, or the whole name in an alias column. Each way is an equi-join; a row found in several comes once. queries: id, family_name, given_name."""
    low = lambda c: F.lower(F.trim(c))
    q = queries.select("id", low("family_name").alias("f"), low("given_name").alias("g")).distinct()
    r = rows.filter("fields is not null").select("file", "row_no", low(F.col("fields")[surname]).alias("s"), low(F.col("fields")[given]).alias("v"), *[low(F.col("fields")[a]).alias(f"a{i}") for i, a in enumerate(aliases or [])])
    both = q.filter("f <> '' AND g <> ''").join(r, (F.col("f") == F.col("s")) & (F.col("g") == F.col("v")))
    one = q.withColumn("m", F.when((F.coalesce("g", F.lit("")) == "") & (F.col("f") != ""), F.col("f")).when((F.coalesce("f", F.lit("")) == "") & (F.col("g") != ""), F.col("g"))).filter("m is not null")
    either = one.join(r.select("file", "row_no", F.explode(F.array("s", "v")).alias("m")).distinct(), "m")
    cols = ["id", "file", "row_no"]
    out = both.select(*cols).unionByName(either.select(*cols))
    for i in range(len(aliases or [])):
        whole = q.filter("f <> '' AND g <> ''").withColumn("m", F.explode(F.array(F.concat_ws(" ", "g", "f"), F.concat_ws(" ", "f", "g"))))
        out = out.unionByName(whole.join(r.withColumnRenamed(f"a{i}", "m").select("file", "row_no", "m"), "m").select(*cols))
    return out.distinct()


def recognition_words(df: DataFrame, key: str, tsv: str) -> DataFrame:
    """(key, page, block, paragraph, line, word, confidence, left, top, width, height, text) from a recogniser's tab-separated output.

    Rows with fewer than twelve fields, the heading, and rows that aren't words (no text) are left out.
    """
    f = F.split(F.col("row"), "\t")
    rows = df.select(key, F.explode(F.split(tsv, r"\r?\n")).alias("row")).filter((F.size(f) >= 12) & ~F.col("row").startswith("level"))
    num = lambda i, n: f[i].cast("int").alias(n)
    out = rows.select(key, num(1, "page"), num(2, "block"), num(3, "paragraph"), num(4, "line"), num(5, "word"), f[10].cast("double").alias("confidence"), num(6, "left"), num(7, "top"), num(8, "width"), num(9, "height"), F.trim(f[11]).alias("text"))
    return out.filter("text <> ''")


def recognition_lines(words: DataFrame, key: str) -> DataFrame:
    """Lines of words: text in order, mean confidence (negative ones are none), hull of the boxes."""
    at = [key, "page", "block", "paragraph", "line"]
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ")  # as long as a line
    return words.groupBy(*at).agg(said.alias("text"), F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))).alias("confidence"), F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"))


def extract_texts(files: DataFrame) -> DataFrame:
    """(path, kind, status, text) of files (path, content) by their kind: csv, html, docx, plain; others are unsupported, broken ones failed."""
    from .files import _docx, _rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, c in zip(pdf["path"], pdf["content"]):
                ext = p.rsplit(".", 1)[-1].lower() if "." in p else ""
                kind = {"csv": "csv", "tsv": "csv", "htm": "html", "html": "html", "docx": "docx", "txt": "plain", "md": "plain"}.get(ext, "")
                try:
                    text = None if not kind else _docx(c) if kind == "docx" else _rows(c.decode("utf-8", "replace")) if kind == "csv" else c.decode("utf-8", "replace")
                    out.append((p, kind, "ok" if kind else "unsupported", text))
                except Exception:  # noqa: BLE001 - a broken file is reported, the others go on
                    out.append((p, kind, "failed", None))
            yield pd.DataFrame(out, columns=["path", "kind", "status", "text"])

    from ..functions.text import strip_tags

    t = files.select("path", "content").mapInPandas(run, "path string, kind string, status string, text string")
    return t.withColumn("text", F.when(F.col("kind") == "html", strip_tags("text")).otherwise(F.col("text")))
