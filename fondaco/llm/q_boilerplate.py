"""Problem 6: a site's furniture around the main body of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .boilerplate import find_furniture, main_body


def web_pages(spark: SparkSession, d: str) -> DataFrame:
    """(src, rec_id, text, title, site) of both tables; a hit's site is its host, a fetched page's its source."""
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^\w+://([^/:]+)", 1)
    hits = table(spark, d, "search_hits").select(F.lit("search_hits").alias("src"), F.col("hit_id").alias("rec_id"), F.col("content").alias("text"), "title", host.alias("site"))
    pages = table(spark, d, "detail_pages").select(F.lit("detail_pages").alias("src"), F.col("page_id").alias("rec_id"), F.col("body_text").alias("text"), F.col("heading").alias("title"), F.col("source_id").alias("site"))
    return hits.unionByName(pages)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return find_furniture(web_pages(spark, d), ["src", "rec_id"], "text", "title", "site").select("src", "rec_id", "line_no")


def p6_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The main body of each page."""
    return main_body(web_pages(spark, d), ["src", "rec_id"], "text", "title", "site")


QUERIES = {"p6_found": p6_found, "p6_bodies": p6_bodies}
SQL: dict = {}
