"""Problem 2: records of one person or organisation under variant spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .linkage import link_names, pairs_of


def named_records(spark: SparkSession, d: str) -> DataFrame:
    """(key, name, birth, death, place) of the three tables."""
    none = F.lit(None).cast("string")
    c = table(spark, d, "caduti").select(F.concat(F.lit("caduti:"), F.col("caduto_id").cast("string")).alias("key"), F.col("nome").alias("name"), F.col("nascita").alias("birth"), F.col("morte").alias("death"), none.alias("place"))
    j = lambda k: F.get_json_object("payload_json", f"$.{k}")
    q = table(spark, d, "person_queries").select(F.concat(F.lit("person_queries:"), F.col("id").cast("string")).alias("key"), F.col("full_name").alias("name"), j("birth_date").alias("birth"), j("death_date").alias("death"), j("birth_place").alias("place"))
    p = table(spark, d, "profile_names").select(F.concat(F.lit("profile_names:"), F.col("profile_id")).alias("key"), F.col("matched_name").alias("name"), none.alias("birth"), none.alias("death"), none.alias("place"))
    return c.unionByName(q).unionByName(p)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_of(link_names(named_records(spark, d)))


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its cluster and the number of records in it."""
    c = link_names(named_records(spark, d))
    return c.join(c.groupBy("cluster").agg(F.count(F.lit(1)).alias("records")), "cluster").select("key", "cluster", "records")


QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters}
SQL: dict = {}
