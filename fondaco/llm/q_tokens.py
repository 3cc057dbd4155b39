"""Problem 7: the corpus as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .tokens import count_tokens, decode, encode, encode_with_offsets, vocabulary


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text", vocabulary(spark))


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    return encode_with_offsets(table(spark, d, "documents"), "doc_id", "text", vocabulary(spark))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text made again from its ids (null and empty texts come back empty)."""
    path = vocabulary(spark)
    return p7_ids(spark, d).select("doc_id", decode("ids", path).alias("text"))


def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens per source."""
    sizes = count_tokens(table(spark, d, "documents"), "doc_id", "text", vocabulary(spark), ("source",))
    return sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))


QUERIES = {"p7_ids": p7_ids, "p7_offsets": p7_offsets, "p7_round_trip": p7_round_trip, "p7_sizes": p7_sizes}
SQL = {"p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
