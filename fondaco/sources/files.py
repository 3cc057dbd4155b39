"""Files as tables: registers, catalogs, glossaries, raw inventories, office documents, loose CSV."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTER = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "intestazione_pdf", "nome", "origine_sulla_lapide", "nascita", "morte", "ruolo_affiliazione", "fonti_richiamate", "profilo_biografico", "episodio_documentato")])
GLOSSARY = T.StructType([T.StructField("entries", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("@id", "term", "language", "category", "translation_it", "review_status")] + [T.StructField("aliases", T.ArrayType(T.StringType()))])))])


def read_register(spark: SparkSession, path: str, schema: T.StructType = REGISTER) -> DataFrame:
    """A CSV register with a header; missing cells are blank strings."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"').fillna("")


def read_catalog(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON-LD records, one per file or an array in one, under a declared schema."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all glossary files, the first of each id by term."""
    e = spark.read.json(path, schema=GLOSSARY, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")
    return e.groupBy("@id").agg(F.min_by(F.struct(*[c for c in e.columns if c != "@id"]), "term").alias("x")).select("@id", "x.*")


def inventory(spark: SparkSession, folder: str, sidecar: str = ".metadata.json") -> DataFrame:
    """Every file below a folder with size and SHA-256, without the content files that a sidecar describes."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    f = f.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))
    owned = f.filter(F.col("path").endswith(sidecar)).select(F.expr(f"substring(path, 1, length(path) - {len(sidecar)})").alias("path"))
    return f.join(owned, "path", "left_anti")


def _docx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p"))


def docx_text(content: Column) -> Column:
    """Paragraphs of an office document; null for a file that is none."""

    def run(s: pd.Series) -> pd.Series:
        def one(b):
            try:
                return _docx(bytes(b))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                return None

        return s.map(one, na_action="ignore")

    return F.pandas_udf(run, T.StringType())(content)


def _rows(text: str) -> str:
    head = text.split("\n", 1)[0]
    mark = max(",;\t|", key=head.count)
    rows = list(csv.reader(io.StringIO(text), delimiter=mark))
    if not rows:
        return ""
    names = rows[0]
    return "\n".join(f"Riga {i}. " + "; ".join(f"{n.strip()}: {v.strip()}" for n, v in zip(names, r) if v.strip()) for i, r in enumerate(rows[1:], 1) if any(v.strip() for v in r))


def csv_text(text: Column) -> Column:
    """Loose CSV as labelled lines; the separator is the most frequent one of the first line."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(_rows, na_action="ignore")

    return F.pandas_udf(run, T.StringType())(text)


def csv_rows(text: Column) -> Column:
    """array<struct<row, fields>> of the labelled lines of :func:`csv_text`."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^Riga [0-9]+\. "))
    field = lambda x: F.struct(F.trim(F.split_part(x, F.lit(": "), F.lit(1))).alias("k"), F.regexp_replace(x, r"^[^:]*: ", "").alias("v"))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^Riga ([0-9]+)\.", 1).cast("int").alias("row"), F.transform(F.split(F.regexp_replace(x, r"^Riga [0-9]+\. ", ""), "; "), field).alias("fields")))


def safe_name(value: str) -> str:
    """A file name of a value's letters and digits."""
    return re.sub(r"[^\w.-]+", "-", value).strip("-") or "leer"


def read_registry(spark: SparkSession, path: str, root: str = "sources") -> DataFrame:
    """(source_id, enabled, fields map<string,string>) of a YAML registry of sources; a list of entries with ids or a mapping by id.

    A registry is a file that people write, so it is read on the driver.
    """
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a registry needs PyYAML") from e
    text = "\n".join(r.value for r in spark.read.format("text").option("wholetext", "true").load(path).collect())
    listed = (yaml.safe_load(text) or {}).get(root) or {}
    entries = listed.items() if isinstance(listed, dict) else [(e.get("id"), e) for e in listed if isinstance(e, dict)]
    rows = [(str(k), bool(v.get("enabled", True)), {str(a): str(b) for a, b in v.items() if b is not None and not isinstance(b, (dict, list))}) for k, v in entries if k is not None and isinstance(v, dict)]
    return spark.createDataFrame(rows, "source_id string, enabled boolean, fields map<string,string>")
