"""Queries that link documents to persons, places and terms by what stands in their texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.phrases import name_tier, phrase_form, phrase_matches, turned
from ..operators.relational import unique_match
from ..session import table
from .base import Registry

query = Registry()


def _n():
    return F.count(F.lit(1))


_T = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_FORM = "array_to_string(" + _T + ", ' ')"
_IN_TEXT = "(SELECT doc_id, text, ' ' || " + _FORM.format("text") + " || ' ' AS t FROM documents WHERE text IS NOT NULL)"
_NAMES = f"(SELECT DISTINCT profile_id, matched_name AS name, {_FORM.format('matched_name')} AS f, CASE WHEN len({_T.format('matched_name')}) > 1 THEN array_to_string(list_concat({_T.format('matched_name')}[-1:], {_T.format('matched_name')}[:-2]), ' ') END AS r FROM profile_names WHERE matched_name IS NOT NULL AND {_FORM.format('matched_name')} <> '')"


@query(
    "j04_persons_in_texts",
    f"""SELECT doc_id, profile_id, CASE min(k) WHEN 1 THEN 'exact' WHEN 2 THEN 'normalised' ELSE 'reversed' END AS tier FROM (SELECT doc_id, profile_id, CASE WHEN contains(t, ' ' || f || ' ') AND contains(text, name) THEN 1 WHEN contains(t, ' ' || f || ' ') THEN 2 WHEN contains(t, ' ' || r || ' ') THEN 3 END AS k
    FROM {_IN_TEXT} d JOIN {_NAMES} n ON contains(t, ' ' || f || ' ') OR contains(t, ' ' || r || ' ')) GROUP BY 1, 2""",
)
def persons_in_texts(spark, d):
    """Documents and profiles whose names stand in them, with the best of three tiers.

    The name forms meet the texts' runs of tokens; only hits are looked at again for the exact spelling.
    """
    names = table(spark, d, "profile_names").filter("matched_name is not null").select("profile_id", F.col("matched_name").alias("name")).distinct()
    names = names.withColumn("form", phrase_form("name")).filter("form <> ''")
    ways = names.select("profile_id", "name", "form", F.lit(2).alias("k")).unionByName(names.select("profile_id", "name", turned("form").alias("form"), F.lit(3).alias("k")).filter("form is not null"))
    docs = table(spark, d, "documents").select("doc_id", "text").filter("text is not null")
    hits = phrase_matches(docs, "doc_id", "text", ways).select("doc_id", "form").distinct().join(ways, "form").join(docs, "doc_id")
    k = F.when((F.col("k") == 2) & F.col("text").contains(F.col("name")), 1).otherwise(F.col("k"))
    best = hits.groupBy("doc_id", "profile_id").agg(F.min(k).alias("k"))
    return best.select("doc_id", "profile_id", F.when(F.col("k") == 1, "exact").when(F.col("k") == 2, "normalised").otherwise("reversed").alias("tier"))


@query(
    "j05_name_tiers",
    f"""SELECT DISTINCT candidate_id, CASE WHEN contains(' ' || a || ' ', ' ' || f || ' ') AND contains(canonical_name, matched_name) THEN 'exact' WHEN contains(' ' || a || ' ', ' ' || f || ' ') THEN 'normalised' WHEN contains(' ' || a || ' ', ' ' || r || ' ') THEN 'reversed' END AS tier
    FROM (SELECT p.*, {_FORM.format('canonical_name')} AS a, n.f, n.r FROM profile_names p JOIN {_NAMES} n ON n.profile_id = p.profile_id AND n.name = p.matched_name WHERE canonical_name IS NOT NULL)""",
)
def _(spark, d):
    t = table(spark, d, "profile_names").filter("canonical_name is not null AND matched_name is not null")
    return t.filter(phrase_form("matched_name") != "").select("candidate_id", name_tier("canonical_name", "matched_name").alias("tier")).distinct()


_TERMS = f"(SELECT DISTINCT {_FORM.format('ruolo_affiliazione')} AS f FROM caduti WHERE {_FORM.format('ruolo_affiliazione')} <> '')"
_RUNS = f"(SELECT doc_id, i - 1 AS pos, array_to_string(t[i:i + n - 1], ' ') AS f FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM (SELECT doc_id, {_T.format('text')} AS t FROM documents WHERE text IS NOT NULL), (SELECT DISTINCT len(string_split(f, ' ')) AS n FROM {{terms}}) WHERE len(t) >= n))"


@query("j15_glossary_terms", f"SELECT doc_id, f AS form, count(*) AS n, CAST(min(pos) AS BIGINT) AS first_pos FROM {_RUNS.replace('{terms}', _TERMS)} JOIN {_TERMS} USING (f) GROUP BY 1, 2")
def _(spark, d):
    """Terms of a glossary (the register's roles) in texts: how often each and at which token first."""
    terms = table(spark, d, "caduti").select(phrase_form("ruolo_affiliazione").alias("form")).filter("form <> ''").distinct()
    return phrase_matches(table(spark, d, "documents"), "doc_id", "text", terms).groupBy("doc_id", "form").agg(_n().alias("n"), F.min("pos").alias("first_pos"))


_LABELS = f"(SELECT DISTINCT place_id, {_FORM.format('label')} AS f FROM (SELECT place_id, preferred_label AS label FROM places UNION ALL SELECT place_id, unnest(alternate_labels) FROM places) WHERE {_FORM.format('label')} <> '')"


def catalog_labels(spark, d):
    """(place_id, form) of every label of the catalog."""
    p = table(spark, d, "places")
    labels = F.concat(F.array("preferred_label"), F.coalesce("alternate_labels", F.array().cast("array<string>")))
    return p.select("place_id", F.explode(labels).alias("label")).select("place_id", phrase_form("label").alias("form")).filter("form <> ''").distinct()


@query("g04_catalog_phrases", f"SELECT f AS form, count(DISTINCT place_id) AS entries FROM {_LABELS} GROUP BY 1")
def _(spark, d):
    """The phrases that a catalog's labels are looked for by, each once, with the number of entries that bear it."""
    return catalog_labels(spark, d).groupBy("form").agg(F.countDistinct("place_id").alias("entries"))


@query(
    "j11_catalog_entries_in_texts",
    f"""SELECT doc_id, f AS form, n, matches, CASE WHEN matches = 1 THEN place_id END AS place_id FROM (SELECT doc_id, f, count(*) AS n FROM {_RUNS.replace('{terms}', _LABELS)} SEMI JOIN {_LABELS} USING (f) GROUP BY 1, 2) JOIN (SELECT f, count(DISTINCT place_id) AS matches, min(place_id) AS place_id FROM {_LABELS} GROUP BY 1) USING (f)""",
)
def entries_in_texts(spark, d):
    """Catalog entries that texts name: a label of several entries is ambiguous and names none."""
    labels = catalog_labels(spark, d)
    hits = phrase_matches(table(spark, d, "documents"), "doc_id", "text", labels).groupBy("doc_id", "form").agg(_n().alias("n"))
    return unique_match(hits, labels, "form", "place_id")


@query(
    "j19_typed_relations",
    f"""SELECT doc_id, 'person' AS kind, profile_id AS target FROM ({query.SQL['j04_persons_in_texts']}) UNION SELECT doc_id, 'place', place_id FROM ({query.SQL['j11_catalog_entries_in_texts']}) WHERE place_id IS NOT NULL UNION SELECT doc_id, 'term', form FROM ({query.SQL['j15_glossary_terms']})""",
)
def relations(spark, d):
    """Links to persons, places and terms as one typed relation."""
    terms = QUERIES["j15_glossary_terms"](spark, d).select("doc_id", F.lit("term").alias("kind"), F.col("form").alias("target"))
    places = entries_in_texts(spark, d).filter("place_id is not null").select("doc_id", F.lit("place").alias("kind"), F.col("place_id").alias("target"))
    return persons_in_texts(spark, d).select("doc_id", F.lit("person").alias("kind"), F.col("profile_id").alias("target")).unionByName(places).unionByName(terms).distinct()


@query(
    "j17_resolved_profiles",
    f"""SELECT q.id, count(DISTINCT p.profile_id) AS profiles, CASE WHEN count(DISTINCT p.profile_id) = 0 THEN 'none' WHEN count(DISTINCT p.profile_id) = 1 THEN 'resolved' WHEN count(DISTINCT CASE WHEN p.confidence >= 0.9 THEN p.profile_id END) = 1 THEN 'best' ELSE 'ambiguous' END AS outcome
    FROM (SELECT DISTINCT id, {_FORM.format('full_name')} AS f FROM person_queries WHERE {_FORM.format('full_name')} <> '') q LEFT JOIN (SELECT profile_id, {_FORM.format('matched_name')} AS f, max(confidence) AS confidence FROM profile_names GROUP BY 1, 2) p USING (f) GROUP BY 1""",
)
def _(spark, d):
    """Queries resolved to profiles by their names: none, one, the only one with a high confidence, or several."""
    q = table(spark, d, "person_queries").select("id", phrase_form("full_name").alias("form")).filter("form <> ''").distinct()
    p = table(spark, d, "profile_names").groupBy("profile_id", phrase_form("matched_name").alias("form")).agg(F.max("confidence").alias("confidence"))
    found = q.join(p, "form", "left").groupBy("id").agg(F.countDistinct("profile_id").alias("profiles"), F.countDistinct(F.when(F.col("confidence") >= 0.9, F.col("profile_id"))).alias("sure"))
    n = F.col("profiles")
    return found.select("id", "profiles", F.when(n == 0, "none").when(n == 1, "resolved").when(F.col("sure") == 1, "best").otherwise("ambiguous").alias("outcome"))


@query(
    "j20_claims_from_rows",
    f"""SELECT DISTINCT q.id, c.caduto_id, m.k AS field, CASE m.k WHEN 'birth' THEN c.nascita WHEN 'death' THEN c.morte ELSE c.ruolo_affiliazione END AS value FROM person_queries q JOIN caduti c ON {_FORM.format('q.full_name')} = {_FORM.format('c.nome')} AND {_FORM.format('q.full_name')} <> '', (VALUES ('birth'), ('death'), ('role')) m(k)
    WHERE trim(coalesce(CASE m.k WHEN 'birth' THEN c.nascita WHEN 'death' THEN c.morte ELSE c.ruolo_affiliazione END, '')) <> ''""",
)
def _(spark, d):
    """Register rows of queried persons, their columns turned into claims by a mapping of columns to fields."""
    q = table(spark, d, "person_queries").select("id", phrase_form("full_name").alias("form")).filter("form <> ''").distinct()
    c = table(spark, d, "caduti").select("caduto_id", phrase_form("nome").alias("form"), "nascita", "morte", "ruolo_affiliazione").distinct()
    claims = F.expr("stack(3, 'birth', nascita, 'death', morte, 'role', ruolo_affiliazione) AS (field, value)")
    return q.join(c, "form").select("id", "caduto_id", claims).filter(F.trim(F.coalesce("value", F.lit(""))) != "").distinct()


@query("g05_text_entities", f"""SELECT kind, n, count(*) AS documents FROM (SELECT doc_id, kind, count(*) AS n FROM ({query.SQL['j19_typed_relations']}) GROUP BY 1, 2) GROUP BY 1, 2""")
def _(spark, d):
    """How many documents name how many different entities of each kind."""
    return relations(spark, d).groupBy("doc_id", "kind").agg(_n().alias("n")).groupBy("kind", "n").agg(_n().alias("documents"))


_QUEUE_DOCS = "(SELECT DISTINCT lower(trim(source_document_id)) AS k FROM review_queue_items WHERE trim(coalesce(source_document_id, '')) <> '')"


@query("j23_known_references", f"SELECT k, EXISTS (SELECT 1 FROM source_documents s WHERE lower(trim(s.document_id)) = k) AS known FROM {_QUEUE_DOCS}")
def _(spark, d):
    """Referenced document ids, known or not."""
    r = table(spark, d, "review_queue_items").select(F.lower(F.trim("source_document_id")).alias("k")).filter("k <> ''").distinct()
    s = table(spark, d, "source_documents").select(F.lower(F.trim("document_id")).alias("k"), F.lit(True).alias("hit")).distinct()
    return r.join(s, "k", "left").select("k", F.coalesce("hit", F.lit(False)).alias("known"))


@query("j24_conflicts_with_decisions", """SELECT a.profile_id, a.candidate_field AS field, a.n AS candidates, coalesce(b.n, 0) AS decided FROM (SELECT profile_id, candidate_field, count(DISTINCT candidate_value) AS n FROM review_queue_items WHERE profile_id IS NOT NULL AND candidate_field IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT candidate_value) > 1) a LEFT JOIN (SELECT profile_id, candidate_field, count(DISTINCT item_id) AS n FROM review_queue_items WHERE subject_kind = 'candidate_evidence_claim' GROUP BY 1, 2) b USING (profile_id, candidate_field)""")
def _(spark, d):
    """Fields of a profile with competing values, and the claims that decide about them."""
    r = table(spark, d, "review_queue_items").filter("profile_id is not null AND candidate_field is not null")
    a = r.groupBy("profile_id", F.col("candidate_field").alias("field")).agg(F.countDistinct("candidate_value").alias("candidates")).filter("candidates > 1")
    b = r.filter("subject_kind = 'candidate_evidence_claim'").groupBy("profile_id", F.col("candidate_field").alias("field")).agg(F.countDistinct("item_id").alias("decided"))
    return a.join(b, ["profile_id", "field"], "left").fillna(0, ["decided"])


@query("j28_reviewed_diff", """SELECT change, count(*) AS n FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL AND a.reviewed THEN 'protected' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' WHEN a.reviewed THEN 'protected' ELSE 'changed' END AS change
 FROM (SELECT place_source_file || '|' || matched_label AS k, max(preferred_label) AS v, max(review_status = 'reviewed' OR review_status = 'accepted') AS reviewed FROM place_labels WHERE candidate_id % 3 <> 0 AND matched_label IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT place_source_file || '|' || matched_label AS k, max(preferred_label) AS v FROM place_labels WHERE candidate_id % 3 <> 1 AND matched_label IS NOT NULL GROUP BY 1) b ON a.k = b.k) GROUP BY 1""")
def _(spark, d):
    """Two versions of a set of labels (the two deliveries are told apart by id): reviewed rows are protected from change."""
    t = table(spark, d, "place_labels").filter("matched_label is not null AND place_source_file is not null").withColumn("k", F.concat_ws("|", "place_source_file", "matched_label"))
    a = t.filter("candidate_id % 3 <> 0").groupBy("k").agg(F.max("preferred_label").alias("va"), F.max(F.col("review_status").isin("reviewed", "accepted")).alias("reviewed"), F.lit(True).alias("ha"))
    b = t.filter("candidate_id % 3 <> 1").groupBy("k").agg(F.max("preferred_label").alias("vb"), F.lit(True).alias("hb"))
    kept = F.coalesce("reviewed", F.lit(False))
    change = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull() & kept, "protected").when(F.col("hb").isNull(), "removed").when(F.col("va").eqNullSafe(F.col("vb")), "unchanged").when(kept, "protected").otherwise("changed")
    return a.join(b, "k", "full_outer").groupBy(change.alias("change")).agg(_n().alias("n"))


@query("j35_profile_documents", """SELECT profile_id, source_document_id AS document, count(*) AS items, count_if(item_type = 'claim') AS claims, count(DISTINCT candidate_field) AS fields FROM (SELECT DISTINCT item_id, profile_id, source_document_id, item_type, candidate_field FROM review_queue_items) WHERE profile_id IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    """What a profile's records say, per document."""
    r = table(spark, d, "review_queue_items").select("item_id", "profile_id", "source_document_id", "item_type", "candidate_field").distinct().filter("profile_id is not null")
    return r.groupBy("profile_id", F.col("source_document_id").alias("document")).agg(_n().alias("items"), F.count_if(F.col("item_type") == "claim").alias("claims"), F.countDistinct("candidate_field").alias("fields"))


@query("j36_why_empty", """SELECT p.profile_id, CASE WHEN (SELECT count(*) FROM review_queue_items) = 0 THEN 'store_empty' WHEN coalesce(r.n, 0) = 0 THEN 'other_profiles' WHEN r.recent = 0 THEN 'other_times' ELSE 'found' END AS reason FROM (SELECT DISTINCT profile_id FROM profile_names) p LEFT JOIN (SELECT profile_id, count(*) AS n, count_if(registered_at >= TIMESTAMP '2024-01-01') AS recent FROM review_queue_items GROUP BY 1) r USING (profile_id)""")
def _(spark, d):
    """Why a profile has no records since a day: an empty store, none of its own, or older ones only."""
    q = table(spark, d, "review_queue_items").withColumn("at", F.col("registered_at").cast("timestamp_ntz"))
    r = q.groupBy("profile_id").agg(_n().alias("n"), F.count_if(F.col("at") >= F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("recent"))
    total = q.agg(_n().alias("total"))  # one row
    p = table(spark, d, "profile_names").select("profile_id").distinct().join(r, "profile_id", "left").join(F.broadcast(total))
    return p.select("profile_id", F.when(F.col("total") == 0, "store_empty").when(F.coalesce("n", F.lit(0)) == 0, "other_profiles").when(F.col("recent") == 0, "other_times").otherwise("found").alias("reason"))


QUERIES, SQL = query.QUERIES, query.SQL
