"""Problem 3: records whose reference names no live parent, per table and month."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import earliest_delivery, orphan_references, reference_key
from ..session import table

#: child table, its key, its reference, parent table, the parent's key
REFERENCES = [
    ("source_documents", "document_id", "run_id", "search_runs", "run_id"),
    ("source_results", "id", "run_id", "search_runs", "run_id"),
    ("review_queue_items", "item_id", "source_document_id", "source_documents", "document_id"),
]


def _cases(spark: SparkSession, d: str, child: str, key: str, ref: str, parent: str, pkey: str) -> DataFrame:
    c = earliest_delivery(table(spark, d, child), key, "registered_at", [ref]).withColumn("ref", reference_key(ref))
    p = table(spark, d, parent).select(reference_key(pkey).alias("parent_key"), "registered_at", "deleted_at")
    found = orphan_references(c, p, [("ref", "parent_key")], "simple", "registered_at", "registered_at", "deleted_at")
    return found.select(
        F.lit(child).alias("child_table"),
        F.col(key).cast("string").alias("child_key"),
        F.date_format("registered_at", "yyyy-MM").alias("period"),
        "status",
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [_cases(spark, d, *r) for r in REFERENCES])


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """The report: cases per table, month and status."""
    return p3_found(spark, d).groupBy("child_table", "period", "status").agg(F.count(F.lit(1)).alias("n"))


def _sql(child: str, key: str, ref: str, parent: str, pkey: str) -> str:
    trim = "lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
    return f"""
    SELECT '{child}' AS child_table, CAST(c.k AS VARCHAR) AS child_key, strftime(c.t, '%Y-%m') AS period,
      CASE WHEN EXISTS (SELECT 1 FROM {parent} p WHERE {trim.format('p.' + pkey)} = c.r AND p.registered_at <= c.t) THEN 'deleted'
           WHEN EXISTS (SELECT 1 FROM {parent} p WHERE {trim.format('p.' + pkey)} = c.r) THEN 'late' ELSE 'missing' END AS status
    FROM (SELECT k, t, r FROM (
            SELECT {key} AS k, registered_at AS t, {trim.format(ref)} AS r,
              row_number() OVER (PARTITION BY {key} ORDER BY registered_at NULLS LAST, {ref} NULLS FIRST) AS rn
            FROM {child} WHERE {key} IS NOT NULL) WHERE rn = 1 AND r <> '') c
    WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE {trim.format('p.' + pkey)} = c.r AND p.registered_at <= c.t
      AND (p.deleted_at IS NULL OR p.deleted_at > c.t))"""


P3_SQL = " UNION ALL ".join(_sql(*r) for r in REFERENCES)

def p3_composite(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose pair of run and source no result has; where one of the two is null, the other one alone must be there (partial match)."""
    c = earliest_delivery(table(spark, d, "source_documents"), "document_id", "registered_at", ["run_id", "source_id"])
    c = c.select("document_id", reference_key("run_id").alias("r"), reference_key("source_id").alias("s"))
    p = table(spark, d, "source_results").select(reference_key("run_id").alias("pr"), reference_key("source_id").alias("ps"))
    found = orphan_references(c, p, [("r", "pr"), ("s", "ps")], "partial")
    mask = F.when(F.col("r").isNull(), "run_null").when(F.col("s").isNull(), "source_null").otherwise("whole")
    return found.select("document_id", mask.alias("mask"), "status")


_KEY = "nullif(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '')"
P3_COMPOSITE = f"""SELECT document_id, CASE WHEN r IS NULL THEN 'run_null' WHEN s IS NULL THEN 'source_null' ELSE 'whole' END AS mask, 'missing' AS status FROM (SELECT document_id, {_KEY.format('run_id')} AS r, {_KEY.format('source_id')} AS s FROM
 (SELECT document_id, run_id, source_id, row_number() OVER (PARTITION BY document_id ORDER BY registered_at NULLS LAST, run_id NULLS FIRST, source_id NULLS FIRST) AS rn FROM source_documents WHERE document_id IS NOT NULL) WHERE rn = 1) c
 WHERE NOT (r IS NULL AND s IS NULL) AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {_KEY.format('run_id')} AS pr, {_KEY.format('source_id')} AS ps FROM source_results) p WHERE (c.r IS NULL OR c.r = p.pr) AND (c.s IS NULL OR c.s = p.ps))"""

QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts, "p3_composite": p3_composite}
SQL = {
    "p3_found": P3_SQL,
    "p3_counts": f"SELECT child_table, period, status, count(*) AS n FROM ({P3_SQL}) GROUP BY child_table, period, status",
    "p3_composite": P3_COMPOSITE,
}
