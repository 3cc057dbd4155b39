"""Problem 9: documents that are template residue, filler, error messages or script notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .residue import find_residue


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay."""
    docs = table(spark, d, "documents")
    return docs.join(find_residue(docs, "doc_id", "text").select("doc_id"), "doc_id", "left_anti")


def p9_labels(spark: SparkSession, d: str) -> DataFrame:
    """Documents left out, by label."""
    return find_residue(table(spark, d, "documents"), "doc_id", "text").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p9_found": p9_found, "p9_kept": p9_kept, "p9_labels": p9_labels}
SQL: dict = {}
