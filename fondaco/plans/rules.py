"""Queries on row-level rules: verdicts, classes, captures, quality marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.html import passes
from ..functions.text import MOJIBAKE, mojibake
from ..operators.phrases import phrase_form, phrase_matches
from ..operators.relational import first_match
from ..operators.rules import captures, first_rule, messages
from ..session import table
from .base import Registry

query = Registry()


def _n():
    return F.count(F.lit(1))


RESULT_RULES = [
    {"id": "failed", "when": {"status": {"in": ["error", "blocked", "timeout"]}}},
    {"id": "nothing", "when": {"hits": 0}},
    {"id": "bounded", "when": {"hits": {"between": [1, 3]}}},
    {"id": "broad", "when": {"hits": {"greater": 3}}},
]


@query(
    "pf11_result_verdicts",
    """SELECT source_id, CASE WHEN coalesce(status IN ('error', 'blocked', 'timeout'), false) THEN 'failed' WHEN coalesce(h = 0, false) THEN 'nothing' WHEN coalesce(h BETWEEN 1 AND 3, false) THEN 'bounded' WHEN coalesce(h > 3, false) THEN 'broad' ELSE 'unknown' END AS verdict, count(*) AS n
    FROM (SELECT source_id, status, CAST(json_extract_string(payload_json, '$.hit_count') AS BIGINT) AS h FROM source_results) GROUP BY ALL""",
)
def _(spark, d):
    r = table(spark, d, "source_results")
    cols = {"status": F.col("status"), "hits": F.get_json_object("payload_json", "$.hit_count").cast("long")}
    return r.groupBy("source_id", first_rule(RESULT_RULES, cols, "unknown").alias("verdict")).agg(_n().alias("n"))


# The classes of documents in the order of their rules.
_MEDIA = r"(SELECT DISTINCT document_id, title, url, lower(coalesce(local_path, '')) AS f, coalesce(json_extract_string(payload_json, '$.media_type'), '') AS m, CASE WHEN trim(coalesce(content_hash, '')) <> '' THEN 'stored' WHEN trim(coalesce(local_path, '')) = '' THEN 'reference_only' ELSE '' END AS s FROM source_documents)"
_CLASS = """CASE WHEN m LIKE 'image/%' THEN 'image_scan' WHEN coalesce(contains(lower(title), 'search'), false) OR coalesce(contains(url, 'advanced-search'), false) THEN 'result_page' WHEN s = 'reference_only' THEN 'reference_page' WHEN m IN ('text/html', 'application/xhtml+xml') THEN 'html_document'
 WHEN m = 'application/pdf' OR f LIKE '%.pdf' THEN 'pdf_document' WHEN m = 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' OR f LIKE '%.docx' THEN 'word_document' WHEN m IN ('text/csv', 'application/vnd.ms-excel') OR regexp_matches(f, '[.](csv|xls|xlsx)$') THEN 'tabular_document' WHEN s = 'stored' THEN 'generic_document' ELSE 'unknown' END"""


def document_classes(spark, d):
    """(document_id, title, status, class): a document's class by its media type, title, address and whether it is stored."""
    t = table(spark, d, "source_documents").select("document_id", "title", "url", "local_path", "payload_json", "content_hash").distinct()
    m, f = F.coalesce(F.get_json_object("payload_json", "$.media_type"), F.lit("")), F.lower(F.coalesce("local_path", F.lit("")))
    s = F.when(F.trim(F.coalesce("content_hash", F.lit(""))) != "", "stored").when(F.trim(F.coalesce("local_path", F.lit(""))) == "", "reference_only").otherwise("")
    has = lambda c, x: F.coalesce(c.contains(x), F.lit(False))
    c = first_match(
        [
            (m.like("image/%"), "image_scan"), (has(F.lower("title"), "search") | has(F.col("url"), "advanced-search"), "result_page"), (s == "reference_only", "reference_page"), (m.isin("text/html", "application/xhtml+xml"), "html_document"),
            ((m == "application/pdf") | f.endswith(".pdf"), "pdf_document"), ((m == "application/vnd.openxmlformats-officedocument.wordprocessingml.document") | f.endswith(".docx"), "word_document"),
            (m.isin("text/csv", "application/vnd.ms-excel") | f.rlike("[.](csv|xls|xlsx)$"), "tabular_document"), (s == "stored", "generic_document"),
        ],
        "unknown",
    )
    return t.select("document_id", "title", s.alias("status"), c.alias("class"))


@query("pf04_document_classes", f"SELECT {_CLASS} AS class, count(*) AS n FROM {_MEDIA} GROUP BY 1")
def _(spark, d):
    return document_classes(spark, d).groupBy("class").agg(_n().alias("n"))


@query(
    "pf05_text_quality",
    f"""SELECT quality, class, count(*) AS n FROM (SELECT {_CLASS} AS class, coalesce(p.n, 0) AS n FROM {_MEDIA} d LEFT JOIN (SELECT h.url AS u, max(length(trim(coalesce(h.content, '')))) AS n FROM search_hits h GROUP BY 1) p ON p.u = d.url) x, LATERAL (SELECT CASE WHEN class = 'result_page' THEN 'audit_only' WHEN class = 'reference_page' THEN 'metadata_only' WHEN class = 'image_scan' AND n > 0 THEN 'ready_for_manual_review' WHEN class = 'image_scan' THEN 'manual_ocr_required' WHEN n > 0 THEN 'ready_for_manual_review' ELSE 'manual_review_required' END AS quality) GROUP BY ALL""",
)
def _(spark, d):
    """The seven rules on class and text: what a document is good for."""
    texts = table(spark, d, "search_hits").groupBy("url").agg(F.max(F.length(F.trim(F.coalesce("content", F.lit(""))))).alias("n"))
    t = table(spark, d, "source_documents").select("document_id", "url").distinct()
    j = document_classes(spark, d).join(t, "document_id").join(texts, "url", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    c, n = F.col("class"), F.col("n") > 0
    q = F.when(c == "result_page", "audit_only").when(c == "reference_page", "metadata_only").when((c == "image_scan") & n, "ready_for_manual_review").when(c == "image_scan", "manual_ocr_required").when(n, "ready_for_manual_review").otherwise("manual_review_required")
    return j.groupBy(q.alias("quality"), "class").agg(_n().alias("n"))


PATTERNS = {"born": [r"(?:nato|nata) il ([^,(]+)", r"geb\. ([^,(]+)", r"\bborn ([^,(]+)"], "died": [r"(?:caduto|morto) il ([^,(]+)", r"(?:gef|gest)\. ([^,(]+)", r"† ?([^,(]+)"], "place": [r"\(([^()0-9]+)\)\s*$"]}


@query("pf13_captures", "SELECT DISTINCT document_id, " + ", ".join(f"coalesce({', '.join(f'nullif(regexp_extract(title, {chr(39)}{p}{chr(39)}, 1), {chr(39)}{chr(39)})' for p in ps)}) AS {k}" for k, ps in PATTERNS.items()) + " FROM source_documents WHERE title IS NOT NULL")
def _(spark, d):
    c = captures(F.col("title"), PATTERNS)
    return table(spark, d, "source_documents").filter("title is not null").select("document_id", *[v.alias(k) for k, v in c.items()]).distinct()


@query("pf16_name_filter", "SELECT DISTINCT id FROM person_queries WHERE contains(lower(coalesce(full_name, '')), 'ett') OR contains(lower(coalesce(family_name, '')), 'ett')")
def _(spark, d):
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("ett")
    return table(spark, d, "person_queries").filter(has("full_name") | has("family_name")).select("id").distinct()


@query("pf27_first_value", "SELECT DISTINCT item_id, coalesce(nullif(trim(profile_id), ''), nullif(trim(canonical_name), ''), nullif(trim(source_document_id), ''), 'none') AS subject FROM review_queue_items")
def _(spark, d):
    v = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "review_queue_items").select("item_id", F.coalesce(v("profile_id"), v("canonical_name"), v("source_document_id"), F.lit("none")).alias("subject")).distinct()


@query(
    "pf34_record_messages",
    """SELECT document_id, CASE WHEN len(m) > 0 THEN array_to_string(m, ';') ELSE 'complete' END AS messages FROM (SELECT DISTINCT document_id, list_filter([CASE WHEN trim(coalesce(title, '')) = '' THEN 'no title' END, CASE WHEN trim(coalesce(run_id, '')) = '' THEN 'no run' END, CASE WHEN deleted_at IS NOT NULL THEN 'withdrawn' END], lambda x: x IS NOT NULL) AS m FROM source_documents)""",
)
def _(spark, d):
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    m = messages([(blank("title"), "no title"), (blank("run_id"), "no run"), (F.col("deleted_at").isNotNull(), "withdrawn")], "complete")
    return table(spark, d, "source_documents").select("document_id", F.array_join(m, ";").alias("messages")).distinct()


@query("pf39_mojibake", "SELECT doc_id, " + " OR ".join(f"contains(text, '{m}')" for m in MOJIBAKE) + " AS suspect FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", mojibake("text").alias("suspect"))


@query("pf15_link_filter", "SELECT source_id, count(*) AS n FROM (SELECT DISTINCT document_id, source_id FROM source_documents WHERE (coalesce(regexp_matches(title, '/scheda/'), false) OR coalesce(regexp_matches(url, '/scheda/'), false)) AND NOT (coalesce(regexp_matches(title, '(?i)mappa|karte'), false) OR coalesce(regexp_matches(url, '(?i)mappa|karte'), false))) GROUP BY 1")
def _(spark, d):
    """Links whose title or address matches a pattern to include and none to exclude."""
    t = table(spark, d, "source_documents").filter(passes(F.col("title"), F.col("url"), ["/scheda/"], ["(?i)mappa|karte"]))
    return t.select("document_id", "source_id").distinct().groupBy("source_id").agg(_n().alias("n"))


_RUN = r"array_to_string(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), ' ')"


@query("f18_place_mappings", f"SELECT q.id, min(m.mapping_id) AS mapping_id FROM (SELECT DISTINCT id, ' ' || {_RUN.format('p')} || ' ' AS p FROM (SELECT id, json_extract_string(payload_json, '$.birth_place') AS p FROM person_queries) WHERE p IS NOT NULL) q JOIN (SELECT mapping_id, {_RUN.format('t')} AS t FROM (SELECT mapping_id, unnest(match_terms) AS t FROM source_place_mappings)) m ON m.t <> '' AND contains(q.p, ' ' || m.t || ' ') GROUP BY 1")
def _(spark, d):
    """The first mapping one of whose terms occurs in a query's place."""
    q = table(spark, d, "person_queries").select("id", F.get_json_object("payload_json", "$.birth_place").alias("p")).filter("p is not null").distinct()
    m = table(spark, d, "source_place_mappings").select("mapping_id", F.explode("match_terms").alias("t")).select("mapping_id", phrase_form("t").alias("form")).filter("form <> ''")
    return phrase_matches(q, "id", "p", m).join(m, "form").groupBy("id").agg(F.min("mapping_id").alias("mapping_id"))


QUERIES, SQL = query.QUERIES, query.SQL
