"""Problem 8: documents of all sources mixed to the target shares of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .mixture import Mixture, mix
from .tokens import count_tokens, vocabulary


def _mixture(spark: SparkSession, d: str) -> Mixture:
    docs = table(spark, d, "documents")
    return mix(count_tokens(docs, "doc_id", "text", vocabulary(spark), ("source",)), table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """One row per copy: doc_id, source, copy, n_tokens, block, slot (its place in the mixture), source_offset."""
    return _mixture(spark, d).mixed


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixture(spark, d).shares


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict = {}
