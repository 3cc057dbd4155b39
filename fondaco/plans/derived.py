"""Queries that derive records: list rows, claims from detail fields, guarded entities, reconciliations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relational import first_wins
from ..session import table
from .base import Registry
from .text import document_mentions
from .text import query as text

query = Registry()


def _n():
    return F.count(F.lit(1))


_ROW = r"(?:^|\n)([0-9]+\. [^,\n]+, [^,\n]+, 1[89][0-9]{2})"


@query("g07_list_rows", rf"""SELECT doc_id, CAST(split_part(r, '. ', 1) AS INT) AS row_no, split_part(regexp_replace(r, '^[0-9]+\. ', ''), ', ', 1) AS name, split_part(r, ', ', 2) AS place, split_part(r, ', ', 3) AS year, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_ROW}', 1)) AS r FROM documents) GROUP BY ALL""")
def list_rows(spark, d):
    """Numbered rows "n. name, place, year" of lists in texts."""
    r = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_ROW), F.lit(1))).alias("r"))
    part = lambda c, sep, k: F.split_part(c, F.lit(sep), F.lit(k))
    r = r.select("doc_id", part(F.col("r"), ". ", 1).cast("int").alias("row_no"), part(F.regexp_replace("r", r"^[0-9]+\. ", ""), ", ", 1).alias("name"), part(F.col("r"), ", ", 2).alias("place"), part(F.col("r"), ", ", 3).alias("year"))
    return r.groupBy("doc_id", "row_no", "name", "place", "year").agg(_n().alias("n"))


@query("j34_listed_persons", f"SELECT name, year, count(DISTINCT doc_id) AS documents, EXISTS (SELECT 1 FROM profile_names p WHERE p.canonical_name = name) AS known FROM ({query.SQL['g07_list_rows']}) GROUP BY name, year")
def _(spark, d):
    known = table(spark, d, "profile_names").select(F.col("canonical_name").alias("name"), F.lit(True).alias("k")).distinct()
    return list_rows(spark, d).groupBy("name", "year").agg(F.countDistinct("doc_id").alias("documents")).join(known, "name", "left").select("name", "year", "documents", F.coalesce("k", F.lit(False)).alias("known"))


MAPPINGS = [("birth_date", "birth", 0.8), ("birth_place", "birth", 0.6), ("death_date", "death", 0.8)]


@query(
    "j14_claims_from_fields",
    "SELECT p.id, m.k AS field, m.claim, json_extract_string(p.payload_json, '$.' || m.k) AS value, least(m.c, 0.9::DOUBLE) AS confidence FROM (SELECT DISTINCT id, payload_json FROM person_queries WHERE payload_json IS NOT NULL) p, (VALUES "
    + ", ".join(f"('{k}', '{c}', {x}::DOUBLE)" for k, c, x in MAPPINGS)
    + ") m(k, claim, c) WHERE trim(coalesce(json_extract_string(p.payload_json, '$.' || m.k), '')) <> ''",
)
def _(spark, d):
    p = table(spark, d, "person_queries").filter("payload_json is not null").select("id", "payload_json").distinct()
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(c).alias("claim"), F.get_json_object("payload_json", f"$.{k}").alias("value"), F.lit(min(x, 0.9)).alias("confidence")) for k, c, x in MAPPINGS])
    return p.select("id", F.explode(fields).alias("f")).select("id", "f.*").filter(F.trim(F.coalesce("value", F.lit(""))) != "")


@query(
    "j12_guarded_entities",
    f"""SELECT m.kind, CASE WHEN d.n_chars < 120 THEN 'short' WHEN d.document_class IS NULL THEN 'no_class' WHEN d.lang IS NULL THEN 'no_language' ELSE 'accepted' END AS outcome, count(*) AS n FROM ({text.SQL['g03_mentions']}) m JOIN documents d USING (doc_id) GROUP BY ALL""",
)
def _(spark, d):
    """Mentions joined to their documents; every one comes out as accepted or with the reason why not."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "document_class", "lang")
    why = F.when(F.col("n_chars") < 120, "short").when(F.col("document_class").isNull(), "no_class").when(F.col("lang").isNull(), "no_language").otherwise("accepted")
    return document_mentions(spark, d).join(docs, "doc_id").groupBy("kind", why.alias("outcome")).agg(_n().alias("n"))


@query("j07_first_links", "SELECT profile_id, source_document_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, source_document_id ORDER BY registered_at NULLS LAST, item_id) AS rn FROM review_queue_items WHERE profile_id IS NOT NULL AND source_document_id IS NOT NULL) WHERE rn = 1")
def _(spark, d):
    r = table(spark, d, "review_queue_items").filter("profile_id is not null AND source_document_id is not null")
    return first_wins(r, ["profile_id", "source_document_id"], [F.asc_nulls_last("registered_at"), F.col("item_id")]).select("profile_id", "source_document_id", "item_id")


@query("j26_page_reconciliation", """SELECT CASE WHEN o.page_id IS NULL THEN 'extra' WHEN r.page_id IS NULL THEN 'missing' ELSE 'both' END AS state, count(*) AS pages FROM (SELECT DISTINCT page_id FROM ocr_pages) o FULL JOIN (SELECT DISTINCT page_id FROM page_references) r ON o.page_id = r.page_id GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "ocr_pages").select("page_id", F.lit(True).alias("o")).distinct()
    r = table(spark, d, "page_references").select("page_id", F.lit(True).alias("r")).distinct()
    state = F.when(F.col("o").isNull(), "extra").when(F.col("r").isNull(), "missing").otherwise("both")
    return o.join(r, "page_id", "full_outer").groupBy(state.alias("state")).agg(_n().alias("pages"))


@query("ag06_run_coverage", """SELECT run_id, count(*) AS n, count_if(status = 'ok') AS ok, count_if(status = 'no_results') AS empty_results, count_if(status NOT IN ('ok', 'no_results')) AS failed, count(DISTINCT source_id) AS sources FROM source_results WHERE run_id IS NOT NULL GROUP BY 1""")
def _(spark, d):
    s = F.col("status")
    return table(spark, d, "source_results").filter("run_id is not null").groupBy("run_id").agg(_n().alias("n"), F.count_if(s == "ok").alias("ok"), F.count_if(s == "no_results").alias("empty_results"), F.count_if(~s.isin("ok", "no_results")).alias("failed"), F.countDistinct("source_id").alias("sources"))


@query("ag19_kind_coverage", """SELECT subject_kind, count(*) AS n, count_if(trim(coalesce(profile_id, '')) = '') AS unscoped, count(DISTINCT nullif(trim(profile_id), '')) AS profiles, count(DISTINCT nullif(trim(source_document_id), '')) AS documents FROM review_queue_items GROUP BY 1""")
def _(spark, d):
    v = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "review_queue_items").groupBy("subject_kind").agg(_n().alias("n"), F.count_if(F.coalesce(v("profile_id"), F.lit("")) == "").alias("unscoped"), F.countDistinct(v("profile_id")).alias("profiles"), F.countDistinct(v("source_document_id")).alias("documents"))


@query("g13_embedding_similarity", """SELECT label, count(*) AS n, round(avg(s), 4) AS mean_cosine FROM (SELECT e.label, list_cosine_similarity(e.embedding, c.v) AS s FROM embeddings e JOIN (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(x AS DOUBLE))::FLOAT AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1) c USING (label)) GROUP BY 1""")
def _(spark, d):
    """Mean cosine of each vector to the mean vector of its label; means are taken per coordinate, so no group is gathered."""
    e = table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    x = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).join(mean, ["label", "i"])
    s = x.groupBy("label", "vec_id").agg((F.sum(F.col("x") * F.col("m")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("m") * F.col("m")))).alias("s"))
    return s.groupBy("label").agg(_n().alias("n"), F.round(F.avg("s"), 4).alias("mean_cosine"))


QUERIES, SQL = query.QUERIES, query.SQL
