"""Queries on candidates: suggested terms, updates of profiles, searches to run, checks of references, exports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators.phrases import phrase_form
from ..operators.suggestions import nearest_terms
from ..session import table
from .base import Registry
from .reports import _ITEMS, _REASON, items, reason

query = Registry()


def _n():
    return F.count(F.lit(1))


_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_LEXICON = f"(SELECT DISTINCT unnest({_W.format('preferred_label')}) AS term FROM places)"
_NAMES = f"(SELECT DISTINCT unnest({_W.format('matched_label')}) AS word FROM place_labels WHERE matched_label IS NOT NULL)"


@query("g17_lexicon_review", f"SELECT word, CASE WHEN EXISTS (SELECT 1 FROM {_LEXICON} WHERE term = word) THEN 'exact' WHEN EXISTS (SELECT 1 FROM {_LEXICON} WHERE levenshtein(term, word) <= 2 AND abs(length(term) - length(word)) <= 2) THEN 'suggested' ELSE 'unknown' END AS state FROM {_NAMES} WHERE regexp_full_match(word, '[a-z]+')")
def _(spark, d):
    """Words against a lexicon: in it, within two edits of a term, or unknown. Every term within two edits is found, whatever it begins with."""
    words, terms = lexicon_words(spark, d)
    near = nearest_terms(words, terms, 2).select("word").distinct().withColumn("near", F.lit(True))
    exact = terms.select(F.col("term").alias("word"), F.lit(True).alias("exact"))
    j = words.join(exact, "word", "left").join(near, "word", "left")
    return j.select("word", F.when(F.col("exact"), "exact").when(F.col("near"), "suggested").otherwise("unknown").alias("state"))


def lexicon_words(spark, d):
    """(words of written labels, terms of the catalog), plain Latin words, as levenshtein counts bytes in the other engine."""
    words = table(spark, d, "place_labels").select(F.explode(T.word_tokens("matched_label")).alias("word")).filter(F.col("word").rlike("^[a-z]+$")).distinct()
    return words, table(spark, d, "places").select(F.explode(T.word_tokens("preferred_label")).alias("term")).distinct()


@query("t04_suggestions", f"SELECT word, term, edits, pos FROM (SELECT word, term, levenshtein(word, term) AS edits, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, term), term) AS pos FROM {_NAMES} JOIN {_LEXICON} ON abs(length(word) - length(term)) <= 2 WHERE regexp_full_match(word, '[a-z]+') AND regexp_full_match(term, '[a-z]+') AND levenshtein(word, term) BETWEEN 1 AND 2 AND NOT EXISTS (SELECT 1 FROM {_LEXICON} x WHERE x.term = word)) WHERE pos <= 3")
def _(spark, d):
    """For each word that the lexicon lacks, its three nearest terms within two edits."""
    words, terms = lexicon_words(spark, d)
    p = nearest_terms(words.join(terms.withColumnRenamed("term", "word"), "word", "left_anti"), terms.filter(F.col("term").rlike("^[a-z]+$")), 2)
    w = Window.partitionBy("word").orderBy("edits", "term")
    return p.withColumn("pos", F.row_number().over(w)).filter("pos <= 3").select("word", "term", F.col("edits").cast("long").alias("edits"), F.col("pos").cast("long").alias("pos"))


@query("o35_dictionary_terms", f"SELECT term, EXISTS (SELECT 1 FROM {_LEXICON} l WHERE l.term = t.term) AS listed, n FROM (SELECT term, count(*) AS n FROM (SELECT unnest({_W.format('title')}) AS term FROM (SELECT DISTINCT document_id, title FROM source_documents WHERE title IS NOT NULL)) GROUP BY 1) t")
def _(spark, d):
    """Terms of titles, listed in the dictionary or not."""
    t = table(spark, d, "source_documents").filter("title is not null").select("document_id", "title").distinct().select(F.explode(T.word_tokens("title")).alias("term")).groupBy("term").agg(_n().alias("n"))
    listed = table(spark, d, "places").select(F.explode(T.word_tokens("preferred_label")).alias("term")).distinct().withColumn("l", F.lit(True))
    return t.join(listed, "term", "left").select("term", F.coalesce("l", F.lit(False)).alias("listed"), "n")


_REG = r"(SELECT name, max(born) AS born FROM (SELECT array_to_string(regexp_extract_all(lower(nome), '[\p{L}\p{N}]+'), ' ') AS name, nullif(regexp_extract(nascita, '(1[89][0-9]{2})', 1), '') AS born FROM caduti WHERE nome IS NOT NULL) WHERE name <> '' GROUP BY 1)"


@query("g18_profile_updates", rf"""SELECT p.profile_id, r.born, CASE WHEN r.born IS NULL THEN 'link' WHEN c.v IS NULL THEN 'new' WHEN contains(c.v, r.born) THEN 'confirm' ELSE 'conflict' END AS action FROM (SELECT DISTINCT profile_id, array_to_string(regexp_extract_all(lower(canonical_name), '[\p{{L}}\p{{N}}]+'), ' ') AS name FROM profile_names WHERE canonical_name IS NOT NULL) p JOIN {_REG} r USING (name) LEFT JOIN (SELECT profile_id, max(candidate_value) AS v FROM review_queue_items WHERE candidate_field = 'birth_date' GROUP BY 1) c USING (profile_id)""")
def _(spark, d):
    """What the register says of a profile's year of birth: a link only, something new, a confirmation or a conflict."""
    r = table(spark, d, "caduti").filter("nome is not null").select(phrase_form("nome").alias("name"), F.nullif(F.regexp_extract("nascita", "(1[89][0-9]{2})", 1), F.lit("")).alias("born")).filter("name <> ''").groupBy("name").agg(F.max("born").alias("born"))
    p = table(spark, d, "profile_names").filter("canonical_name is not null").select("profile_id", phrase_form("canonical_name").alias("name")).distinct()
    c = table(spark, d, "review_queue_items").filter("candidate_field = 'birth_date'").groupBy("profile_id").agg(F.max("candidate_value").alias("v"))
    j = p.join(r, "name").join(c, "profile_id", "left")
    return j.select("profile_id", "born", F.when(F.col("born").isNull(), "link").when(F.col("v").isNull(), "new").when(F.col("v").contains(F.col("born")), "confirm").otherwise("conflict").alias("action"))


@query("g20_field_updates", f"""SELECT profile_id, field, value, CASE WHEN rivals > 1 THEN 'conflicting' WHEN documents > 1 THEN 'existing' ELSE 'new' END AS state FROM (SELECT profile_id, candidate_field AS field, trim(candidate_value) AS value, count(DISTINCT source_document_id) AS documents, count(*) OVER (PARTITION BY profile_id, candidate_field) AS rivals FROM {_ITEMS} WHERE {_REASON} = 'claim' GROUP BY 1, 2, 3)""")
def _(spark, d):
    """Claims by field and exact value: competing values conflict, one from several documents exists already."""
    g = items(spark, d).filter(reason() == "claim").groupBy("profile_id", F.col("candidate_field").alias("field"), F.trim("candidate_value").alias("value")).agg(F.countDistinct("source_document_id").alias("documents"))
    rivals = g.groupBy("profile_id", "field").agg(_n().alias("rivals"))
    return g.join(rivals, ["profile_id", "field"]).select("profile_id", "field", "value", F.when(F.col("rivals") > 1, "conflicting").when(F.col("documents") > 1, "existing").otherwise("new").alias("state"))


@query("g22_search_actions", f"SELECT DISTINCT profile_id, 'search_' || coalesce(candidate_field, 'name') AS action, canonical_name AS query FROM {_ITEMS} WHERE trim(coalesce(canonical_name, '')) <> '' AND {_REASON} <> 'claim'")
def _(spark, d):
    """Searches that items without a claim suggest."""
    r = items(spark, d).filter((F.trim(F.coalesce("canonical_name", F.lit(""))) != "") & (reason() != "claim"))
    return r.select("profile_id", F.concat(F.lit("search_"), F.coalesce("candidate_field", F.lit("name"))).alias("action"), F.col("canonical_name").alias("query")).distinct()


@query("j18_planned_searches", f"""SELECT a.profile_id, a.source_id, s.documents, p.profile_id IS NOT NULL AS known_profile FROM (SELECT DISTINCT i.profile_id, d.source_id FROM {_ITEMS} i JOIN source_documents d ON d.document_id = i.source_document_id WHERE i.risk = 'high' OR i.priority = 'high') a LEFT JOIN (SELECT source_id, count(DISTINCT document_id) AS documents FROM source_documents GROUP BY 1) s USING (source_id) LEFT JOIN (SELECT DISTINCT profile_id FROM profile_names) p ON p.profile_id = a.profile_id""")
def _(spark, d):
    """Urgent items with the sources of their documents, the sources' size and whether the profile is known."""
    docs = table(spark, d, "source_documents").select("document_id", "source_id").distinct()
    i = items(spark, d).filter("risk = 'high' OR priority = 'high'").select("profile_id", F.col("source_document_id").alias("document_id"))
    a = i.join(docs, "document_id").select("profile_id", "source_id").distinct()
    s = docs.groupBy("source_id").agg(F.countDistinct("document_id").alias("documents"))
    p = table(spark, d, "profile_names").select("profile_id").distinct().withColumn("k", F.lit(True))
    return a.join(s, "source_id", "left").join(p, "profile_id", "left").select("profile_id", "source_id", "documents", F.coalesce("k", F.lit(False)).alias("known_profile"))


@query("o26_single_dispositions", "SELECT state, count(*) AS items FROM (SELECT CASE WHEN count(DISTINCT candidate_value) = 0 THEN 'none' WHEN count(DISTINCT candidate_value) = 1 THEN 'one' ELSE 'several' END AS state FROM review_queue_items WHERE source_item_id IS NOT NULL GROUP BY source_item_id) GROUP BY 1")
def _(spark, d):
    """Source items by whether they have exactly one value."""
    n = table(spark, d, "review_queue_items").filter("source_item_id is not null").groupBy("source_item_id").agg(F.countDistinct("candidate_value").alias("v"))
    return n.groupBy(F.when(F.col("v") == 0, "none").when(F.col("v") == 1, "one").otherwise("several").alias("state")).agg(_n().alias("items"))


@query("f12_compatible_dates", "SELECT a.caduto_id AS a, b.caduto_id AS b FROM (SELECT DISTINCT caduto_id, lower(trim(nome)) AS k, coalesce(nullif(regexp_extract(nascita, '1[89][0-9]{2}(-[0-9]{2}(-[0-9]{2})?)?', 0), ''), '') AS n FROM caduti) a JOIN (SELECT DISTINCT caduto_id, lower(trim(nome)) AS k, coalesce(nullif(regexp_extract(nascita, '1[89][0-9]{2}(-[0-9]{2}(-[0-9]{2})?)?', 0), ''), '') AS n FROM caduti) b ON a.k = b.k AND a.caduto_id < b.caduto_id WHERE starts_with(a.n, b.n) OR starts_with(b.n, a.n)")
def _(spark, d):
    """Register rows of one name whose partial dates of birth may be one day."""
    t = table(spark, d, "caduti").select("caduto_id", F.lower(F.trim("nome")).alias("k"), F.regexp_extract("nascita", "1[89][0-9]{2}(-[0-9]{2}(-[0-9]{2})?)?", 0).alias("n")).distinct()
    a, b = t.select(F.col("caduto_id").alias("a"), "k", F.col("n").alias("na")), t.select(F.col("caduto_id").alias("b"), "k", F.col("n").alias("nb"))
    return a.join(b, "k").filter("a < b").filter(T.dates_compatible("na", "nb")).select("a", "b")


@query("w04_chunk_flags", "SELECT doc_id, i AS chunk_index, i > 0 AS overlaps_before, i < n - 1 AS overlaps_after FROM (SELECT doc_id, n, unnest(range(0, n)) AS i FROM (SELECT doc_id, CAST(greatest(ceil((length(text) - 300) / 4200.0), 1) AS BIGINT) AS n FROM documents WHERE length(text) > 0))")
def _(spark, d):
    """Chunks in order with whether they overlap the one before and the one behind."""
    from ..operators.documents import stride_chunks

    c = stride_chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 4_500, 300)
    n = F.length("text")
    t = table(spark, d, "documents").select("doc_id", n.alias("n"))
    return c.join(t, "doc_id").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), (F.col("chunk_index") > 0).alias("overlaps_before"), (F.col("char_end") < F.col("n")).alias("overlaps_after"))


@query("r41_query_export", "SELECT DISTINCT caduto_id, trim(nome) AS name, nullif(trim(nascita), '') AS birth, nullif(trim(morte), '') AS death FROM caduti WHERE trim(coalesce(nome, '')) <> ''")
def _(spark, d):
    v = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "caduti").filter(F.trim(F.coalesce("nome", F.lit(""))) != "").select("caduto_id", F.trim("nome").alias("name"), v("nascita").alias("birth"), v("morte").alias("death")).distinct()


@query("r42_profile_index", "SELECT profile_id, min(canonical_name) AS name, min(profile_source_file) AS file, count(DISTINCT matched_name) AS forms FROM profile_names GROUP BY 1")
def _(spark, d):
    return table(spark, d, "profile_names").groupBy("profile_id").agg(F.min("canonical_name").alias("name"), F.min("profile_source_file").alias("file"), F.countDistinct("matched_name").alias("forms"))


@query("r24_selection_coverage", f"SELECT s.source_id, count(DISTINCT s.document_id) AS documents, count(DISTINCT CASE WHEN i.k IS NOT NULL THEN s.document_id END) AS reviewed FROM source_documents s LEFT JOIN (SELECT DISTINCT source_document_id AS k FROM {_ITEMS} WHERE source_document_id IS NOT NULL) i ON i.k = s.document_id GROUP BY 1")
def _(spark, d):
    """Of each source's documents, those that some review item speaks of."""
    i = items(spark, d).filter("source_document_id is not null").select(F.col("source_document_id").alias("document_id")).distinct().withColumn("k", F.lit(True))
    s = table(spark, d, "source_documents").select("source_id", "document_id").distinct().join(i, "document_id", "left")
    return s.groupBy("source_id").agg(F.countDistinct("document_id").alias("documents"), F.countDistinct(F.when(F.col("k"), F.col("document_id"))).alias("reviewed"))


@query("r01_claim_queue", f"SELECT i.item_id, i.profile_id, i.source_document_id FROM {_ITEMS} i SEMI JOIN (SELECT DISTINCT document_id FROM source_documents WHERE deleted_at IS NULL) s ON s.document_id = i.source_document_id WHERE {_REASON} = 'claim'")
def _(spark, d):
    """Claims whose document is known and not withdrawn."""
    s = table(spark, d, "source_documents").filter("deleted_at is null").select(F.col("document_id").alias("source_document_id")).distinct()
    return items(spark, d).filter(reason() == "claim").join(s, "source_document_id", "left_semi").select("item_id", "profile_id", "source_document_id")


_UNIT = r"([\p{L}]+) «([^»]{2,40})»"
# Words before a unit's name, by kind.
UNIT_KINDS = {"gruppo": "group", "brigata": "brigade", "formazione": "formation", "compagnia": "company", "kompanie": "company", "reparto": "detachment", "détachement": "detachment", "section": "section", "column": "column", "colonna": "column", "squadra": "squad"}


@query("f08_named_units", rf"SELECT trim(regexp_replace(lower(v), '\s+', ' ', 'g')) AS unit, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '«([^»]{{2,40}})»', 1)) AS v FROM documents) GROUP BY 1")
def _(spark, d):
    """Names of units as they are compared."""
    t = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("«([^»]{2,40})»"), F.lit(1))).alias("v"))
    return t.groupBy(F.trim(F.regexp_replace(F.lower("v"), r"\s+", " ")).alias("unit")).agg(_n().alias("n"))


@query("f09_unit_kinds", f"SELECT CASE lower(split_part(v, ' «', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in UNIT_KINDS.items()) + r" ELSE 'unit' END AS kind, lower(rtrim(split_part(v, ' «', 2), '»')) AS unit, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}]+ «[^»]{2,40}»')) AS v FROM documents) GROUP BY 1, 2")
def _(spark, d):
    """Names of units with the kind that the word before them says."""
    t = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+ «[^»]{2,40}»"), F.lit(0))).alias("v"))
    word = F.lower(F.split_part("v", F.lit(" «"), F.lit(1)))
    kinds = F.create_map(*[F.lit(x) for kv in UNIT_KINDS.items() for x in kv])
    return t.groupBy(F.coalesce(F.element_at(kinds, word), F.lit("unit")).alias("kind"), F.lower(F.regexp_replace(F.split_part("v", F.lit(" «"), F.lit(2)), "»+$", "")).alias("unit")).agg(_n().alias("n"))


@query("ag29_source_quality", """SELECT source_id, count(*) AS documents, round(count_if(trim(coalesce(title, '')) <> '') * 1.0::DOUBLE / count(*), 6) AS titled, round(count_if(coalesce(content_hash, '') <> '') * 1.0::DOUBLE / count(*), 6) AS hashed, CASE WHEN count_if(trim(coalesce(title, '')) = '') > 0 AND count_if(coalesce(content_hash, '') = '') > 0 THEN 'titles;hashes' WHEN count_if(trim(coalesce(title, '')) = '') > 0 THEN 'titles' WHEN count_if(coalesce(content_hash, '') = '') > 0 THEN 'hashes' ELSE '' END AS issues FROM (SELECT document_id, min(source_id) AS source_id, max(title) AS title, max(content_hash) AS content_hash FROM source_documents GROUP BY 1) GROUP BY 1""")
def _(spark, d):
    """How complete each source's documents are, and what is amiss."""
    t = table(spark, d, "source_documents").groupBy("document_id").agg(F.min("source_id").alias("source_id"), F.max("title").alias("title"), F.max("content_hash").alias("content_hash"))
    titled, hashed = F.trim(F.coalesce("title", F.lit(""))) != "", F.coalesce("content_hash", F.lit("")) != ""
    g = t.groupBy("source_id").agg(_n().alias("documents"), F.count_if(titled).alias("t"), F.count_if(hashed).alias("h"))
    issues = F.concat_ws(";", F.when(F.col("t") < F.col("documents"), "titles"), F.when(F.col("h") < F.col("documents"), "hashes"))
    return g.select("source_id", "documents", F.round(F.col("t") / F.col("documents"), 6).alias("titled"), F.round(F.col("h") / F.col("documents"), 6).alias("hashed"), issues.alias("issues"))


@query("sk06_imported_queries", """SELECT 'query-' || substr(sha256(coalesce(run_id, '') || '|' || coalesce(json_extract_string(payload_json, '$.full_name'), '')), 1, 16) AS query_id, count(*) AS copies, min(json_extract_string(payload_json, '$.birth_date')) AS birth FROM person_queries WHERE payload_json IS NOT NULL GROUP BY 1""")
def _(spark, d):
    """Queries of an export, each under an id that says what it asks, so importing it again adds nothing."""
    j = lambda k: F.get_json_object("payload_json", f"$.{k}")
    key = F.concat(F.coalesce("run_id", F.lit("")), F.lit("|"), F.coalesce(j("full_name"), F.lit("")))
    t = table(spark, d, "person_queries").filter("payload_json is not null")
    return t.groupBy(F.concat(F.lit("query-"), F.substring(F.sha2(key, 256), 1, 16)).alias("query_id")).agg(_n().alias("copies"), F.min(j("birth_date")).alias("birth"))


@query("g24_decided_operations", f"SELECT i.profile_id, i.candidate_field AS field, count(*) AS operations, min('replace /' || i.candidate_field || ' ' || trim(i.candidate_value)) AS first_operation FROM {_ITEMS} i SEMI JOIN (SELECT DISTINCT item_id FROM review_queue_items WHERE list_contains(allowed_decisions, 'accept')) a ON a.item_id = i.item_id WHERE {_REASON} = 'claim' GROUP BY 1, 2")
def _(spark, d):
    """Claims that may be accepted, as operations on their profiles' fields."""
    a = table(spark, d, "review_queue_items").filter(F.array_contains("allowed_decisions", "accept")).select("item_id").distinct()
    op = F.concat(F.lit("replace /"), "candidate_field", F.lit(" "), F.trim("candidate_value"))
    return items(spark, d).filter(reason() == "claim").join(a, "item_id", "left_semi").groupBy("profile_id", F.col("candidate_field").alias("field")).agg(_n().alias("operations"), F.min(op).alias("first_operation"))


QUERIES, SQL = query.QUERIES, query.SQL
