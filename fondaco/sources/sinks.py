"""Tables as files: ordered extracts, partitioned stores, per-entity notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, forget


def write_extract(df: DataFrame, path: str, order: list[str]) -> None:
    """A CSV extract in order (a range partitioning, so the files of a large one are in order too)."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").csv(path, header=True)


def append_store(df: DataFrame, path: str, key: str, by: str) -> int:
    """Insert-or-ignore into a Parquet store partitioned by ``by``; returns how many rows were new.

    Of several new rows with one key the smallest one by all columns stands, so a repeated import stores the same row.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c != key]
    new = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new = cut(new)  # counted and written from one table
    n = new.count()
    new.write.mode("append").partitionBy(by).parquet(path)
    forget(new)
    return n


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def replace_run(df: DataFrame, path: str, run: str, runs: list[str] | None = None) -> None:
    """Replace runs' rows: the partitions of the rows are written anew; those of ``runs`` without rows are deleted.

    A run whose new delivery is empty thus keeps nothing of its old rows.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)
    if runs:
        have = {r[0] for r in df.filter(F.col(run).isin(runs)).select(run).distinct().collect()}  # at most the given runs
        for gone in set(runs) - have:
            p, fs = _path(spark, f"{path}/{run}={gone}")
            fs.delete(p, True)


#: The line below which a note is the reader's own.
OWN_NOTES = "## Own notes"


def write_notes(df: DataFrame, path: str, key: str, text: str) -> None:
    """One note per entity, written by the executors; what stands below OWN_NOTES in the note of before is kept.

    Notes are written beside the old ones, which are replaced when all are there.
    """
    spark = df.sparkSession
    new = df.select(F.col(key).cast("string").alias(key), F.col(text).alias("__new"))
    if _exists(spark, path):
        old = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract(F.input_file_name(), rf"/{key}=([^/]*)/", 1).alias("__k"), F.col("value").alias("__old"))
        own = old.withColumn("__at", F.instr("__old", F.lit(OWN_NOTES))).filter("__at > 0").select(F.expr("url_decode(__k)").alias(key), F.expr("substring(__old, __at)").alias("__own"))
        new = new.join(own, key, "left")
    else:
        new = new.withColumn("__own", F.lit(None).cast("string"))
    body = F.when(F.col("__own").isNull(), F.col("__new")).otherwise(F.concat_ws("\n", F.rtrim("__new"), F.rtrim("__own")))
    beside = f"{path.rstrip('/')}.new"
    new.select(key, body.alias("value")).write.mode("overwrite").partitionBy(key).text(beside)
    p, fs = _path(spark, path)
    fs.delete(p, True)
    fs.rename(_path(spark, beside)[0], p)


def store_raw(df: DataFrame, path: str, text: str, meta: list[str]) -> int:
    """Content-addressed texts: each different text once under its SHA-256, with the fields of ``meta`` beside it; returns how many were new.

    Null texts aren't stored; a text that is there already stays as it is.
    """
    rows = df.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("sha256"), F.col(text).alias("text"), F.to_json(F.struct(*meta)).alias("sidecar"))
    return append_store(rows.withColumn("shard", F.substring("sha256", 1, 2)), path, "sha256", "shard")


def cached_pages(wanted: DataFrame, cache: str, fetch) -> DataFrame:
    """Read-through cache of pages: (url, html) of the wanted urls; those that the cache lacks are fetched once by ``fetch`` and stored.

    wanted: url. fetch: DataFrame of urls -> DataFrame (url, html).
    """
    spark = wanted.sparkSession
    wanted = wanted.select("url").filter("url is not null").distinct()
    missing = wanted.join(spark.read.parquet(cache).select("url"), "url", "left_anti") if _exists(spark, cache) else wanted
    append_store(fetch(missing).select("url", "html").withColumn("shard", F.substring(F.sha2("url", 256), 1, 2)), cache, "url", "shard")
    return spark.read.parquet(cache).join(wanted, "url", "left_semi").select("url", "html")


def write_pages(df: DataFrame, path: str, key: str, text: str, version: str) -> int:
    """Page texts with a manifest of what was written: pages whose text and version are in the manifest already are skipped. Returns how many were written."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("string").alias(key), F.col(text).alias("value"), F.sha2(F.concat_ws("|", F.lit(version), text), 256).alias("sha256"))
    manifest = f"{path}/manifest"
    if _exists(spark, manifest):
        rows = rows.join(spark.read.parquet(manifest).select(key, "sha256"), [key, "sha256"], "left_anti")
    rows = cut(rows)
    n = rows.count()
    if n:
        rows.select(key, "value").write.mode("append").partitionBy(key).text(f"{path}/pages")
        rows.select(key, "sha256").write.mode("append").parquet(manifest)
    forget(rows)
    return n


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
