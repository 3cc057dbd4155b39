"""Problem 5: written place labels mapped to the list of places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .places import map_values


def written_values(spark: SparkSession, d: str) -> DataFrame:
    """(src, rec_key, pos, value) of every value that is neither null nor blank nor identical to a preferred label."""
    labels = table(spark, d, "place_labels").select(F.col("candidate_id").cast("string").alias("rec_key"), "matched_label", "preferred_label")
    rows = labels.select("rec_key", F.lit(0).cast("long").alias("pos"), F.expr("stack(2, 'matched_label', matched_label, 'preferred_label', preferred_label) AS (src, value)"))
    terms = table(spark, d, "source_place_mappings").select(F.col("mapping_id").alias("rec_key"), F.posexplode("match_terms").alias("p", "value"))
    rows = rows.select("src", "rec_key", "pos", "value").unionByName(terms.select(F.lit("match_terms").alias("src"), "rec_key", F.col("p").cast("long").alias("pos"), "value"))
    known = table(spark, d, "places").select(F.col("preferred_label").alias("value")).distinct()
    return rows.filter(F.regexp_replace("value", r"\s+", "") != "").join(known, "value", "left_anti").distinct()


def entries(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "places")
    return p.select(
        F.col("place_id").alias("entry_id"),
        F.explode(F.concat(F.array("preferred_label"), F.coalesce("alternate_labels", F.array().cast("array<string>")))).alias("label"),
        F.col("province_code").alias("code"),
        "province",
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = written_values(spark, d)
    mapped = map_values(rows, entries(spark, d)).select("value", F.col("entry_id").alias("place_id"))
    return rows.join(mapped, "value", "left").select("src", "rec_key", "pos", F.coalesce("place_id", F.lit("")).alias("place_id"))


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The report: values without an entry, and how often each was written."""
    rows = written_values(spark, d)
    mapped = map_values(rows, entries(spark, d))
    return rows.join(mapped, "value", "left").filter(F.coalesce("entry_id", F.lit("")) == "").groupBy("src", "value").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p5_found": p5_found, "p5_unmatched": p5_unmatched}
SQL: dict = {}
