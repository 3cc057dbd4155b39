"""Reports over reviews, decisions, steps and profiles: funnels, registers, differences, readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.incremental import set_digest, step_states
from ..session import table
from .base import Registry

query = Registry()


def _n():
    return F.count(F.lit(1))


_ITEMS = "(SELECT DISTINCT item_id, item_type, subject_kind, profile_id, source_document_id, priority, risk, candidate_field, candidate_value, canonical_name FROM review_queue_items)"


def items(spark, d):
    """Review items, copies of a delivery once."""
    return table(spark, d, "review_queue_items").select("item_id", "item_type", "subject_kind", "profile_id", "source_document_id", "priority", "risk", "candidate_field", "candidate_value", "canonical_name").distinct()


_REASON = "CASE WHEN trim(coalesce(source_document_id, '')) = '' THEN 'no_document' WHEN trim(coalesce(profile_id, '')) = '' THEN 'no_profile' WHEN candidate_field IS NULL THEN 'no_field' WHEN trim(coalesce(candidate_value, '')) = '' THEN 'no_value' ELSE 'claim' END"


def reason():
    """Why an item gives no claim, or that it does."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank("source_document_id"), "no_document").when(blank("profile_id"), "no_profile").when(F.col("candidate_field").isNull(), "no_field").when(blank("candidate_value"), "no_value").otherwise("claim")


@query("ag12_claim_funnel", f"SELECT item_type, {_REASON} AS reason, count(*) AS n FROM {_ITEMS} GROUP BY ALL")
def _(spark, d):
    return items(spark, d).groupBy("item_type", reason().alias("reason")).agg(_n().alias("n"))


@query("ag31_pilot_funnel", f"SELECT subject_kind, count(*) AS n, count_if({_REASON} = 'claim') AS claims, count(DISTINCT CASE WHEN {_REASON} = 'claim' THEN profile_id END) AS profiles, count(DISTINCT CASE WHEN {_REASON} <> 'claim' THEN {_REASON} END) AS reasons FROM {_ITEMS} GROUP BY 1")
def _(spark, d):
    claim = reason() == "claim"
    return items(spark, d).groupBy("subject_kind").agg(_n().alias("n"), F.count_if(claim).alias("claims"), F.countDistinct(F.when(claim, F.col("profile_id"))).alias("profiles"), F.countDistinct(F.when(~claim, reason())).alias("reasons"))


@query("ag15_person_records", f"""SELECT profile_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT subject_kind) FILTER (subject_kind IS NOT NULL)), ',') AS kinds, array_to_string(list_sort(list(DISTINCT candidate_field) FILTER (candidate_field IS NOT NULL)), ',') AS fields, count(DISTINCT source_document_id) AS documents, count_if(item_type = 'claim') AS claims FROM {_ITEMS} WHERE profile_id IS NOT NULL GROUP BY 1""")
def _(spark, d):
    """What is recorded for each person: counts and sorted sets (kinds and fields are few; documents are only counted)."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return items(spark, d).filter("profile_id is not null").groupBy("profile_id").agg(_n().alias("n"), names("subject_kind").alias("kinds"), names("candidate_field").alias("fields"), F.countDistinct("source_document_id").alias("documents"), F.count_if(F.col("item_type") == "claim").alias("claims"))


@query("ag16_document_records", f"""SELECT source_document_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT subject_kind) FILTER (subject_kind IS NOT NULL)), ',') AS kinds, count(DISTINCT profile_id) AS profiles, count_if(coalesce(risk = 'high', false)) AS risky FROM {_ITEMS} WHERE trim(coalesce(source_document_id, '')) <> '' GROUP BY 1""")
def _(spark, d):
    r = items(spark, d).filter(F.trim(F.coalesce("source_document_id", F.lit(""))) != "")
    return r.groupBy("source_document_id").agg(_n().alias("n"), F.array_join(F.array_sort(F.collect_set("subject_kind")), ",").alias("kinds"), F.countDistinct("profile_id").alias("profiles"), F.count_if(F.col("risk") == "high").alias("risky"))


@query("ag17_decision_rows", f"SELECT item_id, profile_id, candidate_field, candidate_value, 'decision-' || substr(sha256(item_id || '|' || coalesce(candidate_value, '')), 1, 16) AS decision_id FROM {_ITEMS} WHERE item_type = 'claim' AND candidate_value IS NOT NULL")
def _(spark, d):
    r = items(spark, d).filter("item_type = 'claim' AND candidate_value is not null")
    return r.select("item_id", "profile_id", "candidate_field", "candidate_value", F.concat(F.lit("decision-"), F.substring(F.sha2(F.concat_ws("|", "item_id", "candidate_value"), 256), 1, 16)).alias("decision_id"))


@query("ag22_conflict_register", f"""SELECT state, fields, count(*) AS profiles FROM (SELECT profile_id, CASE WHEN max(v) > 1 THEN 'conflicting' WHEN max(v) = 1 THEN 'settled' ELSE 'open' END AS state, count(*) AS fields FROM (SELECT profile_id, candidate_field, count(DISTINCT lower(trim(candidate_value))) AS v FROM {_ITEMS} WHERE profile_id IS NOT NULL AND candidate_field IS NOT NULL GROUP BY 1, 2) GROUP BY 1) GROUP BY 1, 2""")
def _(spark, d):
    """Profiles by whether values of their fields compete."""
    v = items(spark, d).filter("profile_id is not null AND candidate_field is not null").groupBy("profile_id", "candidate_field").agg(F.countDistinct(F.lower(F.trim("candidate_value"))).alias("v"))
    p = v.groupBy("profile_id").agg(F.max("v").alias("m"), _n().alias("fields"))
    return p.groupBy(F.when(F.col("m") > 1, "conflicting").when(F.col("m") == 1, "settled").otherwise("open").alias("state"), "fields").agg(_n().alias("profiles"))


_FACTS = f"(SELECT profile_id, candidate_field AS field, min(trim(candidate_value)) AS value, count(DISTINCT source_document_id) AS documents FROM {_ITEMS} WHERE {_REASON} = 'claim' GROUP BY 1, 2 HAVING count(DISTINCT lower(trim(candidate_value))) = 1)"


def facts(spark, d):
    """Fields of profiles on which all claims agree."""
    r = items(spark, d).filter(reason() == "claim").groupBy("profile_id", F.col("candidate_field").alias("field"))
    return r.agg(F.min(F.trim("candidate_value")).alias("value"), F.countDistinct("source_document_id").alias("documents"), F.countDistinct(F.lower(F.trim("candidate_value"))).alias("v")).filter("v = 1").drop("v")


@query("ag23_agreed_facts", f"SELECT * FROM {_FACTS}")
def _(spark, d):
    return facts(spark, d)


@query("ag24_patch_operations", f"SELECT profile_id, count(*) AS operations, array_to_string(list_sort(list('add /' || field || ' ' || value)), ';') AS patch FROM {_FACTS} GROUP BY 1")
def _(spark, d):
    """Agreed facts as operations on a profile, one per field (fields are few)."""
    op = F.concat(F.lit("add /"), "field", F.lit(" "), "value")
    return facts(spark, d).groupBy("profile_id").agg(_n().alias("operations"), F.array_join(F.array_sort(F.collect_list(op)), ";").alias("patch"))


@query("ag27_source_measures", """SELECT source_id, count(*) AS results, round(count_if(status = 'ok') * 1.0::DOUBLE / count(*), 6) AS ok_share, round(avg(h), 6) AS mean_hits, CAST(coalesce(sum(h), 0) AS BIGINT) AS hits FROM (SELECT id, min(source_id) AS source_id, min(status) AS status, max(CAST(json_extract_string(payload_json, '$.hit_count') AS BIGINT)) AS h FROM source_results GROUP BY 1) GROUP BY 1""")
def _(spark, d):
    """Shares, means and sums per source over results counted once."""
    r = table(spark, d, "source_results").groupBy("id").agg(F.min("source_id").alias("source_id"), F.min("status").alias("status"), F.max(F.get_json_object("payload_json", "$.hit_count").cast("long")).alias("h"))
    return r.groupBy("source_id").agg(_n().alias("results"), F.round(F.count_if(F.col("status") == "ok") / _n(), 6).alias("ok_share"), F.round(F.avg("h"), 6).alias("mean_hits"), F.coalesce(F.sum("h"), F.lit(0)).alias("hits"))


@query("ag28_deltas_to_baseline", """SELECT user_id, day, round(candidate - baseline, 6) AS delta, candidates FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count_if(event_type = 'signup') AS baselines, max(CASE WHEN event_type = 'signup' THEN value END) AS baseline, count_if(event_type = 'purchase') AS candidates, avg(CASE WHEN event_type = 'purchase' THEN value END) AS candidate FROM events GROUP BY 1, 2) WHERE baselines = 1 AND candidates >= 1""")
def _(spark, d):
    """Groups with exactly one baseline and a candidate at least: the candidates' mean against it."""
    base, cand = F.col("event_type") == "signup", F.col("event_type") == "purchase"
    g = table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(base).alias("b"), F.max(F.when(base, F.col("value"))).alias("baseline"), F.count_if(cand).alias("candidates"), F.avg(F.when(cand, F.col("value"))).alias("candidate"))
    return g.filter("b = 1 AND candidates >= 1").select("user_id", "day", F.round(F.col("candidate") - F.col("baseline"), 6).alias("delta"), "candidates")


@query("ag30_profile_readiness", f"""SELECT p.profile_id, coalesce(i.links, 0) AS links, coalesce(i.claims, 0) AS claims, coalesce(i.signals, 0) AS signals, coalesce(i.documents, 0) AS documents FROM (SELECT DISTINCT profile_id FROM profile_names) p LEFT JOIN (SELECT i.profile_id, count_if(item_type = 'link') AS links, count_if(item_type = 'claim') AS claims, count_if(subject_kind = 'reviewable_document_signal') AS signals, count(DISTINCT CASE WHEN s.k IS NOT NULL THEN s.k END) AS documents FROM {_ITEMS} i LEFT JOIN (SELECT DISTINCT lower(trim(document_id)) AS k FROM source_documents) s ON s.k = lower(trim(i.source_document_id)) GROUP BY 1) i USING (profile_id)""")
def _(spark, d):
    """Links, claims, signals and known documents of every profile."""
    s = table(spark, d, "source_documents").select(F.lower(F.trim("document_id")).alias("k")).distinct()
    i = items(spark, d).withColumn("r", F.lower(F.trim("source_document_id"))).join(s, F.col("r") == F.col("k"), "left")
    g = i.groupBy("profile_id").agg(F.count_if(F.col("item_type") == "link").alias("links"), F.count_if(F.col("item_type") == "claim").alias("claims"), F.count_if(F.col("subject_kind") == "reviewable_document_signal").alias("signals"), F.countDistinct("k").alias("documents"))
    return table(spark, d, "profile_names").select("profile_id").distinct().join(g, "profile_id", "left").fillna(0, ["links", "claims", "signals", "documents"])


@query("ag34_row_validity", """SELECT validity, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(item_id, '')) = '' THEN 'missing_id' WHEN k > 1 THEN 'duplicate_id' WHEN NOT known AND trim(coalesce(source_document_id, '')) <> '' THEN 'unknown_document' WHEN len(coalesce(allowed_decisions, [])) = 0 THEN 'no_decisions' ELSE 'valid' END AS validity FROM (SELECT i.item_id, i.source_document_id, i.allowed_decisions, i.k, s.id IS NOT NULL AS known FROM (SELECT item_id, min(source_document_id) AS source_document_id, min(allowed_decisions) AS allowed_decisions, count(*) AS k FROM review_queue_items GROUP BY 1) i LEFT JOIN (SELECT DISTINCT lower(trim(document_id)) AS id FROM source_documents) s ON s.id = lower(trim(i.source_document_id)))) GROUP BY 1""")
def _(spark, d):
    """Items by the first thing that makes them invalid."""
    i = table(spark, d, "review_queue_items").groupBy("item_id").agg(F.min("source_document_id").alias("doc"), F.min("allowed_decisions").alias("allowed"), _n().alias("k"))
    s = table(spark, d, "source_documents").select(F.lower(F.trim("document_id")).alias("id")).distinct().withColumn("known", F.lit(True))
    j = i.withColumn("id", F.lower(F.trim("doc"))).join(s, "id", "left")
    v = F.when(F.trim(F.coalesce("item_id", F.lit(""))) == "", "missing_id").when(F.col("k") > 1, "duplicate_id").when(F.col("known").isNull() & (F.trim(F.coalesce("doc", F.lit(""))) != ""), "unknown_document").when(F.coalesce(F.size("allowed"), F.lit(0)) <= 0, "no_decisions").otherwise("valid")
    return j.groupBy(v.alias("validity")).agg(_n().alias("n"))


@query("pf17_claim_fields", r"""SELECT DISTINCT caduto_id, CASE WHEN regexp_matches(lower(profilo_biografico), '\b(?:nato|nata|nacque|geboren|born|né)\b') THEN 'birth' WHEN regexp_matches(lower(profilo_biografico), '\b(?:morto|morta|caduto|caduta|ucciso|gefallen|died|killed)\b') THEN 'death' WHEN regexp_matches(lower(profilo_biografico), '\b(?:brigata|formazione|reparto|kompanie|unit)\b') THEN 'formation' ELSE 'none' END AS field FROM caduti WHERE profilo_biografico IS NOT NULL""")
def _(spark, d):
    """The field that a biography speaks of first by context words."""
    t = F.lower("profilo_biografico")
    field = F.when(t.rlike(r"(?U)\b(?:nato|nata|nacque|geboren|born|né)\b"), "birth").when(t.rlike(r"(?U)\b(?:morto|morta|caduto|caduta|ucciso|gefallen|died|killed)\b"), "death").when(t.rlike(r"(?U)\b(?:brigata|formazione|reparto|kompanie|unit)\b"), "formation").otherwise("none")
    return table(spark, d, "caduti").filter("profilo_biografico is not null").select("caduto_id", field.alias("field")).distinct()


_SNAP = "(SELECT source_id, CAST(sum(CAST(('0x' || substr(md5(document_id || ':' || coalesce(content_hash, '')), 1, 12))::BIGINT AS HUGEINT)) AS VARCHAR) || '-' || CAST(count(*) AS VARCHAR) AS digest FROM (SELECT DISTINCT source_id, document_id, content_hash FROM source_documents WHERE registered_at < TIMESTAMP '{}') GROUP BY 1)"


def snapshot(spark, d, day: str):
    """(source_id, digest) of the documents that were there on a day."""
    t = table(spark, d, "source_documents").filter(F.col("registered_at").cast("timestamp_ntz") < F.lit(f"{day} 00:00:00").cast("timestamp_ntz"))
    return set_digest(t.select("source_id", "document_id", "content_hash").distinct(), ["source_id"], ["document_id", "content_hash"])


@query("st04_input_snapshots", f"SELECT * FROM {_SNAP.format('2024-06-01')}")
def _(spark, d):
    return snapshot(spark, d, "2024-06-01")


@query("st01_step_states", f"SELECT coalesce(a.source_id, b.source_id) AS source_id, CASE WHEN b.digest IS NULL THEN 'gone' WHEN a.digest IS NULL THEN 'run' WHEN a.digest = b.digest THEN 'skip' ELSE 'run_again' END AS state FROM {_SNAP.format('2024-06-01')} a FULL JOIN {_SNAP.format('2024-09-01')} b ON a.source_id = b.source_id")
def _(spark, d):
    """What a step does with each source: its inputs' digest against the one of its last run."""
    return step_states(snapshot(spark, d, "2024-06-01"), snapshot(spark, d, "2024-09-01"), "source_id")


@query("ag32_run_rollup", f"SELECT 'documents' AS stage, count(*) AS n FROM (SELECT DISTINCT document_id FROM source_documents) UNION ALL SELECT 'readable', count(*) FROM (SELECT DISTINCT page_id FROM detail_pages WHERE trim(coalesce(body_text, '')) <> '') UNION ALL SELECT 'claims', count(*) FROM {_ITEMS} WHERE {_REASON} = 'claim' UNION ALL SELECT 'facts', count(*) FROM {_FACTS}")
def _(spark, d):
    one = lambda name, df: df.agg(_n().alias("n")).select(F.lit(name).alias("stage"), "n")
    out = one("documents", table(spark, d, "source_documents").select("document_id").distinct())
    out = out.unionByName(one("readable", table(spark, d, "detail_pages").filter(F.trim(F.coalesce("body_text", F.lit(""))) != "").select("page_id").distinct()))
    return out.unionByName(one("claims", items(spark, d).filter(reason() == "claim"))).unionByName(one("facts", facts(spark, d)))


QUERIES, SQL = query.QUERIES, query.SQL
