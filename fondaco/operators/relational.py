"""Relational operators over an append-only store: versions, upserts, diffs, histograms, uniqueness-aware joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_id(prefix: str, *cols: str | Column) -> Column:
    """Content-addressed id: the prefix and 16 hex digits of the SHA-256 of the parts, nulls as blanks."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order (window rank; the whole row survives)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def newest(df: DataFrame, key: str, at: str, keep: list[str]) -> DataFrame:
    """Insert-or-replace: the latest delivery of each key, by a map-side maximum; ties go to the greatest values."""
    m = df.groupBy(key).agg(F.max(F.struct(at, *keep)).alias("m"))
    return m.select(key, f"m.{at}", *[f"m.{c}" for c in keep])


def insert_new(store: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Insert-or-ignore: rows of the batch whose key the store lacks, one per key."""
    return first_wins(batch.join(store.select(key), key, "left_anti"), [key], order)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """added / removed / modified / unchanged per key, by a full outer join of two snapshots (unique keys)."""
    b, a = before.select(key, F.col(value).alias("__b"), F.lit(True).alias("__hb")), after.select(key, F.col(value).alias("__a"), F.lit(True).alias("__ha"))
    state = F.when(F.col("__hb").isNull(), "added").when(F.col("__ha").isNull(), "removed").when(F.col("__b").eqNullSafe(F.col("__a")), "unchanged").otherwise("modified")
    return b.join(a, key, "full_outer").select(key, state.alias("change"))


def dense_histogram(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """A count for every allowed value, zero where none occurs."""
    spark = df.sparkSession
    allowed = spark.createDataFrame([(v,) for v in values], f"{col} string")
    n = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    return allowed.join(n, col, "left").select(col, F.coalesce("__n", F.lit(0)).alias("n"))


def unique_match(mentions: DataFrame, catalog: DataFrame, on: str, target: str) -> DataFrame:
    """Mentions with ``matches`` (distinct targets) and ``target`` only where exactly one matches."""
    c = catalog.groupBy(on).agg(F.countDistinct(target).alias("matches"), F.min(target).alias("__t"))
    return mentions.join(c, on, "left").select(*mentions.columns, F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("__t")).alias(target))


def islands(df: DataFrame, keys: list[str], order: str, starts: Column) -> DataFrame:
    """Gaps and islands: numbers the runs of rows that a start begins, within each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def pre_aggregated(parent: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Parent rows with a count per child table; each child is counted before its join, so nothing fans out."""
    out = parent
    for name, child in children.items():
        n = child.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def multiset_common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of both multisets with the smaller count (the cardinality of INTERSECT ALL)."""
    na, nb = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("na")), b.groupBy(*keys).agg(F.count(F.lit(1)).alias("nb"))
    return na.join(nb, keys).select(*keys, F.least("na", "nb").alias("n"))


def first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """Ordered rules as one column: the first that holds decides."""
    return reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1])).otherwise(default)
