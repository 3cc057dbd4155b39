"""Problem 4: register rows and document titles about the same person."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .register import match_titles


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its score, the gap to the next person, and its confidence."""
    return match_titles(table(spark, d, "caduti"), table(spark, d, "source_documents"), "caduto_id", "nome", "nascita", "morte", "document_id", "title")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).select("caduto_id", "document_id")


QUERIES = {"p4_found": p4_found, "p4_matches": p4_matches}
SQL: dict = {}
