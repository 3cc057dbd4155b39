"""Incremental steps: digests of input sets and what they say about a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_digest(df: DataFrame, by: list[str], parts: list[str]) -> DataFrame:
    """(by..., digest) of each group's set of rows, whatever their order.

    Every row is hashed by itself and the hashes are added up on the map side, so a group of any size is never gathered. Rows are taken as
    given: make them distinct first where copies mustn't count. Nulls count as blanks.
    """
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    g = df.groupBy(*by).agg(F.sum(h).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select(*by, F.concat_ws("-", F.col("s").cast("decimal(38,0)").cast("string"), F.col("n").cast("string")).alias("digest"))


def step_states(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, state): skip where the digest is the same, run where it is new, run_again where it changed, gone where no input is left."""
    a, b = before.select(key, F.col("digest").alias("a")), now.select(key, F.col("digest").alias("b"))
    state = F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "run").when(F.col("a") == F.col("b"), "skip").otherwise("run_again")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))
