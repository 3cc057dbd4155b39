"""The fixed queries over the evidence store: counts, coverage, recency, versions, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import set_digest
from ..operators.relational import dense_histogram, first_match, first_wins, hash_id, insert_new, multiset_common, newest, pre_aggregated, snapshot_diff
from ..session import table
from .base import Registry

query = Registry()
STORE = ("search_runs", "person_queries", "source_results", "source_documents", "review_queue_items")


def _n():
    return F.count(F.lit(1))



@query("ag01_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in STORE))
def _(spark: SparkSession, d: str) -> DataFrame:
    one = [table(spark, d, t).agg(_n().alias("n")).select(F.lit(t).alias("table_name"), "n") for t in STORE]
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3]).unionByName(one[4])


@query("ag02_results_by_source", "SELECT source_id, status, count(*) AS n FROM source_results GROUP BY source_id, status")
def _(spark, d):
    return table(spark, d, "source_results").groupBy("source_id", "status").agg(_n().alias("n"))


@query("ag03_items_by_kind", "SELECT item_type, subject_kind, priority, count(*) AS n FROM review_queue_items GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "review_queue_items").groupBy("item_type", "subject_kind", "priority").agg(_n().alias("n"))


@query(
    "ag04_top_subjects",
    """SELECT profile_id, count(*) AS n, count(DISTINCT coalesce(source_document_id, '')) AS documents FROM review_queue_items
    WHERE trim(coalesce(profile_id, '')) <> '' GROUP BY profile_id ORDER BY n DESC, profile_id LIMIT 20""",
)
def _(spark, d):
    r = table(spark, d, "review_queue_items").filter(F.trim(F.coalesce("profile_id", F.lit(""))) != "")
    return r.groupBy("profile_id").agg(_n().alias("n"), F.countDistinct(F.coalesce("source_document_id", F.lit(""))).alias("documents")).orderBy(F.desc("n"), "profile_id").limit(20)


@query(
    "ag05_payload_coverage",
    """SELECT source_id, count(*) AS n, count_if(CAST(json_extract_string(payload_json, '$.hit_count') AS INT) > 0) AS with_hits,
    count_if(status = 'ok') AS ok, count_if(run_id IS NULL OR trim(run_id) = '') AS without_run,
    coalesce(sum(CAST(json_extract_string(payload_json, '$.hit_count') AS BIGINT)), 0)::BIGINT AS hits FROM source_results GROUP BY source_id""",
)
def _(spark, d):
    hits = F.get_json_object("payload_json", "$.hit_count").cast("long")
    return table(spark, d, "source_results").groupBy("source_id").agg(
        _n().alias("n"), F.count_if(hits > 0).alias("with_hits"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("run_id").isNull() | (F.trim("run_id") == "")).alias("without_run"), F.coalesce(F.sum(hits), F.lit(0)).alias("hits"),
    )


def instant(c: str):
    """A written point in time (UTC, with or without its mark) as a timestamp; null where it is none."""
    return F.expr(f"try_cast(regexp_replace(replace({c}, 'T', ' '), '(Z|[+]00:00)$', '') AS timestamp_ntz)")


_INSTANT = "TRY_CAST(regexp_replace(replace({0}, 'T', ' '), '(Z|[+]00:00)$', '') AS TIMESTAMP)"
_RUNS = f"SELECT run_id, min({_INSTANT.format('run_timestamp')}) AS started FROM search_runs GROUP BY run_id"


def runs_with_children(spark: SparkSession, d: str) -> DataFrame:
    """Each run with its children counted before the joins; copies of a delivery count once."""
    runs = table(spark, d, "search_runs").groupBy("run_id").agg(F.min(instant("run_timestamp")).alias("started"))
    one = lambda t, k: table(spark, d, t).select("run_id", k).distinct()
    return pre_aggregated(runs, "run_id", {"queries": one("person_queries", "id"), "results": one("source_results", "id"), "documents": one("source_documents", "document_id")})


_CHILDREN = f"""SELECT r.run_id, r.started, coalesce(q.n, 0) AS queries, coalesce(s.n, 0) AS results, coalesce(x.n, 0) AS documents FROM ({_RUNS}) r
    LEFT JOIN (SELECT run_id, count(DISTINCT id) AS n FROM person_queries GROUP BY 1) q USING (run_id)
    LEFT JOIN (SELECT run_id, count(DISTINCT id) AS n FROM source_results GROUP BY 1) s USING (run_id)
    LEFT JOIN (SELECT run_id, count(DISTINCT document_id) AS n FROM source_documents GROUP BY 1) x USING (run_id)"""


@query("j01_runs", _CHILDREN + " ORDER BY started DESC, r.run_id LIMIT 50")
def _(spark, d):
    return runs_with_children(spark, d).orderBy(F.desc("started"), "run_id").limit(50)


_BUSIEST = "(SELECT r.run_id FROM (SELECT DISTINCT run_id FROM search_runs) r JOIN source_results USING (run_id) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def busiest_run(spark, d):
    """The run of search_runs with the most results, ties to the smaller id: one row."""
    r = table(spark, d, "search_runs").select("run_id").distinct().join(table(spark, d, "source_results").groupBy("run_id").agg(_n().alias("k")), "run_id")
    return r.orderBy(F.desc("k"), "run_id").limit(1).select("run_id")


def run_detail(spark, d, runs: DataFrame) -> DataFrame:
    """The children's counts of some runs (run_id, distinct); the filter reaches each child before it is counted."""
    of = lambda t: table(spark, d, t).join(F.broadcast(runs), "run_id", "left_semi")
    started = of("search_runs").groupBy("run_id").agg(F.min(instant("run_timestamp")).alias("started"))
    one = lambda t, k: of(t).select("run_id", k).distinct()
    return pre_aggregated(started, "run_id", {"queries": one("person_queries", "id"), "results": one("source_results", "id"), "documents": one("source_documents", "document_id")})


@query("j02_run_detail", f"SELECT * FROM ({_CHILDREN}) WHERE run_id = {_BUSIEST}")
def _(spark, d):
    return run_detail(spark, d, busiest_run(spark, d))


@query(
    "j03_manual_review",
    """SELECT r.run_id, r.source_id, r.results, coalesce(x.documents, 0) AS documents, r.flagged FROM
    (SELECT run_id, source_id, count(*) AS results, count_if(status <> 'ok') AS flagged FROM source_results WHERE run_id IS NOT NULL GROUP BY 1, 2) r
    LEFT JOIN (SELECT run_id, source_id, count(*) AS documents FROM source_documents GROUP BY 1, 2) x USING (run_id, source_id)
    WHERE r.flagged > 0 OR x.documents IS NULL""",
)
def _(spark, d):
    r = table(spark, d, "source_results").filter("run_id is not null").groupBy("run_id", "source_id").agg(_n().alias("results"), F.count_if(F.col("status") != "ok").alias("flagged"))
    x = table(spark, d, "source_documents").groupBy("run_id", "source_id").agg(_n().alias("documents"))
    return r.join(x, ["run_id", "source_id"], "left").filter("flagged > 0 OR documents IS NULL").withColumn("documents", F.coalesce("documents", F.lit(0)))


@query("t01_recent_documents", "SELECT document_id, source_id, max(title) AS title, max(" + _INSTANT.format("access_date") + ") AS accessed FROM source_documents GROUP BY 1, 2 ORDER BY accessed DESC NULLS LAST, document_id, source_id LIMIT 100")
def _(spark, d):
    t = table(spark, d, "source_documents").groupBy("document_id", "source_id").agg(F.max("title").alias("title"), F.max(instant("access_date")).alias("accessed"))
    return t.orderBy(F.desc_nulls_last("accessed"), "document_id", "source_id").limit(100)


@query("t02_recent_runs", "SELECT run_id, max(registered_at) AS last_at FROM search_runs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def _(spark, d):
    return table(spark, d, "search_runs").groupBy("run_id").agg(F.max("registered_at").alias("last_at")).orderBy(F.desc("last_at"), "run_id").limit(30)


@query("t03_top_queries", "SELECT query, count(*) AS n FROM source_results GROUP BY 1 ORDER BY n DESC, query LIMIT 10")
def _(spark, d):
    return table(spark, d, "source_results").groupBy("query").agg(_n().alias("n")).orderBy(F.desc("n"), "query").limit(10)


@query("t08_events_in_order", "SELECT event_id, event_type, user_id FROM events ORDER BY ts, event_id")
def _(spark, d):
    return table(spark, d, "events").orderBy("ts", "event_id").select("event_id", "event_type", "user_id")


@query(
    "sk01_upsert_documents",
    """SELECT document_id, registered_at, run_id, title, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY registered_at DESC NULLS LAST, run_id DESC NULLS LAST, title DESC NULLS LAST, content_hash DESC NULLS LAST) AS rn FROM source_documents) WHERE rn = 1""",
)
def _(spark, d):
    return newest(table(spark, d, "source_documents"), "document_id", "registered_at", ["run_id", "title", "content_hash"])


RUN_TABLES = {"search_runs": "run_id", "person_queries": "id", "source_results": "id", "source_documents": "document_id"}


@query("sk02_delete_run", " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST({k} AS VARCHAR) AS k, run_id FROM {t} WHERE run_id IS NULL OR run_id <> {_BUSIEST}" for t, k in RUN_TABLES.items()))
def _(spark, d):
    """What is left of each table when a run (the busiest) is deleted from all that bear runs."""
    gone = F.broadcast(busiest_run(spark, d))  # one row
    left = [table(spark, d, t).join(gone, "run_id", "left_anti").select(F.lit(t).alias("table_name"), F.col(k).cast("string").alias("k"), "run_id") for t, k in RUN_TABLES.items()]
    return left[0].unionByName(left[1]).unionByName(left[2]).unionByName(left[3])


@query(
    "sk03_insert_or_ignore",
    """SELECT item_id, registered_at FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY registered_at, question) AS rn FROM review_queue_items b
    WHERE registered_at >= TIMESTAMP '2023-01-01' AND NOT EXISTS (SELECT 1 FROM review_queue_items s WHERE s.item_id = b.item_id AND s.registered_at < TIMESTAMP '2023-01-01')) WHERE rn = 1""",
)
def _(spark, d):
    t = table(spark, d, "review_queue_items")
    cut_at = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    at = F.col("registered_at").cast("timestamp_ntz")
    return insert_new(t.filter(at < cut_at), t.filter(at >= cut_at), "item_id", [F.col("registered_at"), F.col("question")]).select("item_id", "registered_at")


@query(
    "sk04_import_records",
    """SELECT 'record-' || substr(sha256('result|' || CAST(id AS VARCHAR) || '|' || coalesce(run_id, '')), 1, 16) AS record_id, 'result' AS record_kind, count(*) AS copies FROM source_results GROUP BY ALL
    UNION ALL SELECT 'record-' || substr(sha256('document|' || document_id || '|' || coalesce(run_id, '')), 1, 16), 'document', count(*) FROM source_documents GROUP BY ALL""",
)
def _(spark, d):
    one = lambda t, kind, key: table(spark, d, t).groupBy(hash_id("record-", F.lit(kind), key, "run_id").alias("record_id")).agg(_n().alias("copies")).select("record_id", F.lit(kind).alias("record_kind"), "copies")
    return one("source_results", "result", "id").unionByName(one("source_documents", "document", "document_id"))


@query(
    "sk13_dataset_export",
    """SELECT coalesce(nullif(trim(profile_id), ''), 'unscoped') AS person, count(*) AS n, string_agg(DISTINCT subject_kind, ',' ORDER BY subject_kind) AS kinds, min(registered_at) AS first_at FROM review_queue_items GROUP BY 1""",
)
def _(spark, d):
    person = F.coalesce(F.nullif(F.trim("profile_id"), F.lit("")), F.lit("unscoped"))
    # kinds are a fixed vocabulary, so the set is bounded whatever the group's size
    return table(spark, d, "review_queue_items").groupBy(person.alias("person")).agg(_n().alias("n"), F.array_join(F.array_sort(F.collect_set("subject_kind")), ",").alias("kinds"), F.min("registered_at").alias("first_at"))


@query("ag07_exact_duplicates", "SELECT sha256(text) AS text_sha256, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    t = table(spark, d, "documents").filter("text is not null").filter(F.trim("text") != "")
    return t.groupBy(F.sha2("text", 256).alias("text_sha256")).agg(_n().alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("n >= 2")


@query("g15_duplicate_membership", "SELECT d.doc_id, min(e.doc_id) AS class_id, count(*) - 1 AS links FROM documents d JOIN documents e ON sha256(d.text) = sha256(e.text) WHERE d.text IS NOT NULL GROUP BY d.doc_id")
def _(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    c = t.groupBy("h").agg(F.min("doc_id").alias("class_id"), (_n() - 1).alias("links"))
    return t.join(c, "h").select("doc_id", "class_id", "links")


@query(
    "ag08_identity_groups",
    """SELECT key_kind, identity, count(*) AS documents FROM (SELECT CASE WHEN trim(coalesce(text, '')) <> '' THEN 'text' WHEN trim(coalesce(fonds_id, '')) <> '' THEN 'fonds' ELSE 'class' END AS key_kind, coalesce(CASE WHEN trim(coalesce(text, '')) <> '' THEN sha256(text) END, nullif(trim(fonds_id), ''), document_class) AS identity FROM documents) GROUP BY ALL HAVING count(*) >= 2""",
)
def _(spark, d):
    """Documents of one identity, by the first key that each has: its text, its holding, its class."""
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    kind = F.when(full("text"), "text").when(full("fonds_id"), "fonds").otherwise("class")
    key = F.coalesce(F.when(full("text"), F.sha2("text", 256)), F.nullif(F.trim("fonds_id"), F.lit("")), "document_class")
    return table(spark, d, "documents").groupBy(kind.alias("key_kind"), key.alias("identity")).agg(_n().alias("documents")).filter("documents >= 2")


@query(
    "ag09_source_summary",
    """SELECT source_id, count(DISTINCT run_id) AS runs, count(DISTINCT CASE WHEN status = 'ok' THEN query END) AS ok_queries, count_if(status = 'no_results') AS empty_results, count(*) AS n FROM source_results GROUP BY 1""",
)
def _(spark, d):
    return table(spark, d, "source_results").groupBy("source_id").agg(F.countDistinct("run_id").alias("runs"), F.countDistinct(F.when(F.col("status") == "ok", F.col("query"))).alias("ok_queries"), F.count_if(F.col("status") == "no_results").alias("empty_results"), _n().alias("n"))


@query(
    "ag10_profile_summary",
    """SELECT profile_id, count(DISTINCT candidate_id) AS forms, count(DISTINCT normalized_name) AS spellings, max(confidence) AS best, count_if(confidence IS NULL) AS unscored FROM profile_names GROUP BY 1""",
)
def _(spark, d):
    return table(spark, d, "profile_names").groupBy("profile_id").agg(F.countDistinct("candidate_id").alias("forms"), F.countDistinct("normalized_name").alias("spellings"), F.max("confidence").alias("best"), F.count_if(F.col("confidence").isNull()).alias("unscored"))


@query(
    "ag11_allowed_decisions",
    "SELECT decision, priority, count(*) AS n FROM (SELECT unnest(allowed_decisions) AS decision, priority FROM review_queue_items) GROUP BY ALL",
)
def _(spark, d):
    return table(spark, d, "review_queue_items").select(F.explode("allowed_decisions").alias("decision"), "priority").groupBy("decision", "priority").agg(_n().alias("n"))


@query(
    "ag13_document_states",
    """SELECT source_document_id, count(*) AS items, count(DISTINCT profile_id) AS profiles, string_agg(DISTINCT item_type, ',' ORDER BY item_type) AS types,
    CASE WHEN count_if(risk = 'high') > 0 THEN 'high' WHEN count_if(priority = 'high') > 0 THEN 'urgent' ELSE 'plain' END AS state FROM review_queue_items WHERE trim(coalesce(source_document_id, '')) <> '' GROUP BY 1""",
)
def document_states(spark, d):
    r = table(spark, d, "review_queue_items").filter(F.trim(F.coalesce("source_document_id", F.lit(""))) != "")
    state = first_match([(F.count_if(F.col("risk") == "high") > 0, "high"), (F.count_if(F.col("priority") == "high") > 0, "urgent")], "plain")
    return r.groupBy("source_document_id").agg(_n().alias("items"), F.countDistinct("profile_id").alias("profiles"), F.array_join(F.array_sort(F.collect_set("item_type")), ",").alias("types"), state.alias("state"))


@query("ag14_document_coverage", f"SELECT state, count(*) AS documents, sum(items)::BIGINT AS items, max(profiles) AS most_profiles FROM ({query.SQL['ag13_document_states']}) GROUP BY 1")
def _(spark, d):
    return document_states(spark, d).groupBy("state").agg(_n().alias("documents"), F.sum("items").alias("items"), F.max("profiles").alias("most_profiles"))


_STATES = ("unreviewed", "needs_review", "accepted", "rejected", "uncertain", "conflict_open")


@query("ag18_state_histogram", f"SELECT s.review_status, count(p.review_status) AS n FROM (VALUES {', '.join(f'({chr(39)}{s}{chr(39)})' for s in _STATES)}) s(review_status) LEFT JOIN place_labels p ON p.review_status = s.review_status GROUP BY 1")
def _(spark, d):
    return dense_histogram(table(spark, d, "place_labels"), "review_status", list(_STATES))


@query(
    "ag20_ledger_merge",
    """SELECT profile_id, coalesce(source_document_id, '') AS document, count(*) AS deliveries, min(registered_at) AS first_at, max(registered_at) AS last_at, min(item_id) AS first_item FROM review_queue_items WHERE profile_id IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, d):
    r = table(spark, d, "review_queue_items").filter("profile_id is not null")
    return r.groupBy("profile_id", F.coalesce("source_document_id", F.lit("")).alias("document")).agg(_n().alias("deliveries"), F.min("registered_at").alias("first_at"), F.max("registered_at").alias("last_at"), F.min("item_id").alias("first_item"))


@query(
    "ag21_candidate_values",
    """SELECT candidate_field, lower(trim(candidate_value)) AS value, count(*) AS n, count(DISTINCT profile_id) AS profiles, count(DISTINCT source_document_id) AS sources FROM review_queue_items WHERE candidate_value IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    r = table(spark, d, "review_queue_items").filter("candidate_value is not null")
    return r.groupBy("candidate_field", F.lower(F.trim("candidate_value")).alias("value")).agg(_n().alias("n"), F.countDistinct("profile_id").alias("profiles"), F.countDistinct("source_document_id").alias("sources"))


@query("w01_best_name_form", """SELECT profile_id, matched_name, confidence FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY confidence DESC NULLS LAST, candidate_id) AS rn FROM profile_names) WHERE rn = 1""")
def _(spark, d):
    return first_wins(table(spark, d, "profile_names"), ["profile_id"], [F.desc_nulls_last("confidence"), F.col("candidate_id")]).select("profile_id", "matched_name", "confidence")


@query("w02_first_mention", """SELECT normalized_label, mention_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY normalized_label ORDER BY candidate_id, mention_id) AS rn FROM place_labels) WHERE rn = 1""")
def _(spark, d):
    return first_wins(table(spark, d, "place_labels"), ["normalized_label"], [F.col("candidate_id"), F.col("mention_id")]).select("normalized_label", "mention_id", "candidate_id")


@query("w08_attempt_order", "SELECT mapping_id, i - 1 AS pos, match_terms[i] AS term FROM (SELECT mapping_id, match_terms, unnest(range(1, len(match_terms) + 1)) AS i FROM source_place_mappings)")
def _(spark, d):
    return table(spark, d, "source_place_mappings").select("mapping_id", F.posexplode("match_terms").alias("pos", "term")).withColumn("pos", F.col("pos").cast("long"))


@query(
    "j29_snapshot_diff",
    """SELECT coalesce(b.document_id, a.document_id) AS document_id, CASE WHEN b.document_id IS NULL THEN 'added' WHEN a.document_id IS NULL THEN 'removed' WHEN b.h IS NOT DISTINCT FROM a.h THEN 'unchanged' ELSE 'modified' END AS change FROM
    (SELECT document_id, max(content_hash) AS h FROM source_documents WHERE registered_at < TIMESTAMP '2023-06-01' GROUP BY 1) b FULL JOIN
    (SELECT document_id, max(content_hash) AS h FROM source_documents WHERE deleted_at IS NULL GROUP BY 1) a ON a.document_id = b.document_id""",
)
def _(spark, d):
    s = table(spark, d, "source_documents")
    early = s.filter(F.col("registered_at").cast("timestamp_ntz") < F.lit("2023-06-01 00:00:00").cast("timestamp_ntz")).groupBy("document_id").agg(F.max("content_hash").alias("h"))
    late = s.filter("deleted_at is null").groupBy("document_id").agg(F.max("content_hash").alias("h"))
    return snapshot_diff(early, late, "document_id", "h")


@query(
    "st02_signature",
    """SELECT source_id, sha256('v1|source_documents|' || source_id || '|' || CAST(sum(CAST(('0x' || substr(md5(document_id || ':' || coalesce(content_hash, '')), 1, 12))::BIGINT AS HUGEINT)) AS VARCHAR) || '-' || CAST(count(*) AS VARCHAR)) AS signature FROM (SELECT DISTINCT source_id, document_id, content_hash FROM source_documents WHERE source_id IS NOT NULL) GROUP BY 1""",
)
def _(spark, d):
    """A step's signature: its version, name, parameters and the digest of the set it reads."""
    s = table(spark, d, "source_documents").filter("source_id is not null").select("source_id", "document_id", "content_hash").distinct()
    return set_digest(s, ["source_id"], ["document_id", "content_hash"]).select("source_id", F.sha2(F.concat_ws("|", F.lit("v1"), F.lit("source_documents"), "source_id", "digest"), 256).alias("signature"))


@query(
    "set_multiset_common",
    """SELECT word, least(a.n, b.n) AS n FROM (SELECT normalized_name AS word, count(*) AS n FROM profile_names GROUP BY 1) a JOIN (SELECT lower(trim(full_name)) AS word, count(*) AS n FROM person_queries GROUP BY 1) b USING (word)""",
)
def _(spark, d):
    a = table(spark, d, "profile_names").select(F.col("normalized_name").alias("word"))
    b = table(spark, d, "person_queries").select(F.lower(F.trim("full_name")).alias("word"))
    return multiset_common(a, b, ["word"])


@query("sc24_profiles_by_name", "SELECT DISTINCT profile_id, canonical_name FROM profile_names WHERE contains(lower(canonical_name), 'ett')")
def _(spark, d):
    return table(spark, d, "profile_names").filter(F.lower("canonical_name").contains("ett")).select("profile_id", "canonical_name").distinct()


@query("sc25_place_labels", "SELECT place_id, label, min(kind) AS kind FROM (SELECT place_id, preferred_label AS label, 'a_preferred' AS kind FROM places UNION ALL SELECT place_id, unnest(alternate_labels), 'b_alternate' FROM places) GROUP BY ALL")
def place_label_rows(spark, d):
    p = table(spark, d, "places")
    rows = p.select("place_id", F.col("preferred_label").alias("label"), F.lit("a_preferred").alias("kind")).unionByName(p.select("place_id", F.explode("alternate_labels").alias("label"), F.lit("b_alternate").alias("kind")))
    return rows.groupBy("place_id", "label").agg(F.min("kind").alias("kind"))


@query("sc27_existing_documents", "SELECT DISTINCT trim(source_document_id) AS document_id, EXISTS (SELECT 1 FROM source_documents s WHERE s.document_id = trim(r.source_document_id)) AS there FROM review_queue_items r WHERE trim(coalesce(source_document_id, '')) <> ''")
def _(spark, d):
    ids = table(spark, d, "review_queue_items").select(F.trim("source_document_id").alias("document_id")).filter("document_id <> ''").distinct()
    have = table(spark, d, "source_documents").select("document_id", F.lit(True).alias("h")).distinct()
    return ids.join(have, "document_id", "left").select("document_id", F.coalesce("h", F.lit(False)).alias("there"))


QUERIES, SQL = query.QUERIES, query.SQL
