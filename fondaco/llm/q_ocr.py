"""Problem 1: damage in text from scanned pages, and the repaired text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .scanned import Scanned


#: Sources whose records are single pages.
PAGES = ["regions_text", "reference_text"]


def scanned_records(spark: SparkSession, d: str) -> DataFrame:
    """(src, rec_key, lines) of the three sources."""
    pages = table(spark, d, "ocr_pages").select(
        F.lit("regions_text").alias("src"), F.col("page_id").alias("rec_key"),
        F.transform("regions", lambda r: F.struct(r["text"].alias("text"), r["geometry"]["bbox"][0].alias("x0"))).alias("lines"),
    )
    split = lambda c: F.transform(F.split(c, "\n"), lambda t: F.struct(t.alias("text"), F.lit(None).cast("double").alias("x0")))
    refs = table(spark, d, "page_references").filter("text <> ''").select(F.lit("reference_text").alias("src"), F.col("reference_id").alias("rec_key"), split("text").alias("lines"))
    body = table(spark, d, "detail_pages").filter("body_text <> ''").select(F.lit("body_text").alias("src"), F.col("page_id").cast("string").alias("rec_key"), split("body_text").alias("lines"))
    return pages.unionByName(refs).unionByName(body)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return Scanned(scanned_records(spark, d), PAGES).found()


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each record as continuous readable paragraphs."""
    return Scanned(scanned_records(spark, d), PAGES).texts()


QUERIES = {"p1_found": p1_found, "p1_texts": p1_texts}
SQL: dict = {}
