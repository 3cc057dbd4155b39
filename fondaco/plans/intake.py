"""Queries on how documents are taken in: actions, classes, quality, routing, search attempts, result verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators.attempts import Template, attempts
from ..operators.relational import first_match
from ..session import table
from .base import Registry

query = Registry()


def _n():
    return F.count(F.lit(1))


def documents(spark, d):
    """Source documents, one row per delivery content, with media type and extension."""
    t = table(spark, d, "source_documents").select("document_id", "source_id", "title", "url", "local_path", "content_hash", "payload_json").distinct()
    return t.withColumn("media", F.get_json_object("payload_json", "$.media_type")).withColumn("ext", F.lower(F.regexp_extract("local_path", r"\.([A-Za-z0-9]+)$", 1)))


_DOCS = r"(SELECT *, json_extract_string(payload_json, '$.media_type') AS media, lower(regexp_extract(local_path, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM (SELECT DISTINCT document_id, source_id, title, url, local_path, content_hash, payload_json FROM source_documents))"
_MAP = "regexp_matches(lower(concat_ws(' ', title, url)), 'mappa|carta topografica|karte|map of|topograph')"
_ACTION = f"CASE WHEN {_MAP} THEN 'map_candidate' WHEN media LIKE 'image/%' THEN 'recognise' WHEN media = 'application/pdf' OR ext = 'pdf' THEN 'recognise' WHEN media LIKE 'text/%' OR ext IN ('html', 'htm', 'txt', 'csv') THEN 'read_text' WHEN media IS NULL AND coalesce(ext, '') = '' THEN 'manual' ELSE 'unsupported' END"


def action():
    """What is done with a document: the first rule that holds decides."""
    media, ext = F.col("media"), F.col("ext")
    return first_match(
        [(historical_map(), "map_candidate"), (media.like("image/%"), "recognise"), ((media == "application/pdf") | (ext == "pdf"), "recognise"), (media.like("text/%") | ext.isin("html", "htm", "txt", "csv"), "read_text"), (media.isNull() & (F.coalesce(ext, F.lit("")) == ""), "manual")],
        "unsupported",
    )


def historical_map():
    """Whether title or address speak of a map."""
    return F.lower(F.concat_ws(" ", "title", "url")).rlike("mappa|carta topografica|karte|map of|topograph")


@query("pf01_intake_actions", f"SELECT DISTINCT document_id, {_ACTION} AS action FROM {_DOCS}")
def _(spark, d):
    return documents(spark, d).select("document_id", action().alias("action")).distinct()


@query("pf02_map_candidates", f"SELECT DISTINCT document_id, title FROM {_DOCS} WHERE {_MAP}")
def _(spark, d):
    return documents(spark, d).filter(historical_map()).select("document_id", "title").distinct()


@query("pf08_map_catalog", f"SELECT source_id, count(DISTINCT document_id) AS maps, min(title) AS first_title FROM {_DOCS} WHERE {_MAP} GROUP BY 1")
def _(spark, d):
    return documents(spark, d).filter(historical_map()).groupBy("source_id").agg(F.countDistinct("document_id").alias("maps"), F.min("title").alias("first_title"))


@query("ag26_action_histogram", f"SELECT {_ACTION} AS action, source_id, count(*) AS n FROM {_DOCS} GROUP BY ALL")
def _(spark, d):
    return documents(spark, d).groupBy(action().alias("action"), "source_id").agg(_n().alias("n"))


_META = f"SELECT document_id, {_ACTION} AS action, CASE WHEN trim(coalesce(title, '')) = '' THEN 'untitled' ELSE 'titled' END AS naming, coalesce(media, 'unknown') AS media, coalesce(content_hash, '') <> '' AS hashed FROM {_DOCS}"


@query("pf03_processed_metadata", f"SELECT DISTINCT document_id, action, naming, media, hashed, action IN ('recognise', 'read_text') AND hashed AS eligible FROM ({_META})")
def _(spark, d):
    """A document's own fields merged with what was derived, defaults behind both, and whether it goes on."""
    t = documents(spark, d).withColumn("action", action()).withColumn("hashed", F.coalesce("content_hash", F.lit("")) != "")
    naming = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "untitled").otherwise("titled")
    return t.select("document_id", "action", naming.alias("naming"), F.coalesce("media", F.lit("unknown")).alias("media"), "hashed", (F.col("action").isin("recognise", "read_text") & F.col("hashed")).alias("eligible")).distinct()


@query("pf07_image_plans", r"""SELECT page_id, CASE WHEN transform_id IN ('contrast', 'binarise') THEN 'ready' WHEN mean < 0.6 THEN 'enhance' WHEN mean IS NULL THEN 'unscored' ELSE 'plain' END AS preparation, lines FROM (SELECT page_id, min(transform_id) AS transform_id, max(len(regions)) AS lines, round(avg(list_avg(list_transform(regions, lambda x: x.confidence))), 6) AS mean FROM ocr_pages GROUP BY 1)""")
def _(spark, d):
    """How a page's image is prepared before it is read again."""
    conf = F.filter(F.transform("regions", lambda x: x["confidence"]), lambda c: c.isNotNull())
    mean = F.when(F.size(conf) > 0, F.aggregate(conf, F.lit(0.0), lambda a, x: a + x) / F.size(conf))
    p = table(spark, d, "ocr_pages").groupBy("page_id").agg(F.min("transform_id").alias("transform_id"), F.max(F.size("regions")).cast("long").alias("lines"), F.round(F.avg(mean), 6).alias("mean"))
    prep = F.when(F.col("transform_id").isin("contrast", "binarise"), "ready").when(F.col("mean") < 0.6, "enhance").when(F.col("mean").isNull(), "unscored").otherwise("plain")
    return p.select("page_id", prep.alias("preparation"), "lines")


# Recognition packs and rule sets by language.
PACKS = {"it": "ita", "de": "deu", "en": "eng", "fr": "fra", "ru": "rus"}


@query("pf09_language_packs", "SELECT code, coalesce(pack, 'none') AS pack, pack IS NULL AS manual, n FROM (SELECT lower(substr(trim(lang), 1, 2)) AS code, count(*) AS n FROM documents GROUP BY 1) LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in PACKS.items()) + ") p(c, pack) ON c = code")
def _(spark, d):
    packs = spark.createDataFrame(list(PACKS.items()), "code string, p string")
    t = table(spark, d, "documents").groupBy(F.lower(F.substring(F.trim("lang"), 1, 2)).alias("code")).agg(_n().alias("n"))
    return t.join(F.broadcast(packs), "code", "left").select("code", F.coalesce("p", F.lit("none")).alias("pack"), F.col("p").isNull().alias("manual"), "n")


@query("pf06_quality_with_text", """SELECT quality, document_class, count(*) AS n FROM (SELECT m.document_class, CASE WHEN t.doc_id IS NULL THEN 'no_text' WHEN t.chars < 40 THEN 'too_short' WHEN m.document_class IS NULL THEN 'unclassified' ELSE 'usable' END AS quality FROM (SELECT DISTINCT doc_id, document_class FROM documents) m LEFT JOIN (SELECT doc_id, length(trim(text)) AS chars FROM documents WHERE trim(coalesce(text, '')) <> '') t USING (doc_id)) GROUP BY ALL""")
def _(spark, d):
    """Metadata joined to what text there is, then classified."""
    m = table(spark, d, "documents").select("doc_id", "document_class").distinct()
    t = table(spark, d, "documents").filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc_id", F.length(F.trim("text")).alias("chars"), F.lit(True).alias("has"))
    q = F.when(F.col("has").isNull(), "no_text").when(F.col("chars") < 40, "too_short").when(F.col("document_class").isNull(), "unclassified").otherwise("usable")
    return m.join(t, "doc_id", "left").groupBy(q.alias("quality"), "document_class").agg(_n().alias("n"))


@query("ag25_text_status", """SELECT coalesce(document_class, 'none') AS document_class, CASE WHEN text IS NULL THEN 'missing' WHEN trim(text) = '' THEN 'blank' ELSE 'text' END AS status, count(*) AS n FROM documents GROUP BY ALL""")
def _(spark, d):
    status = F.when(F.col("text").isNull(), "missing").when(F.trim("text") == "", "blank").otherwise("text")
    return table(spark, d, "documents").groupBy(F.coalesce("document_class", F.lit("none")).alias("document_class"), status.alias("status")).agg(_n().alias("n"))


@query("ag33_image_readiness", f"""SELECT source_id, count(*) AS documents, count_if(media LIKE 'image/%') AS images, count_if(media LIKE 'image/%' AND coalesce(content_hash, '') <> '') AS hashed_images, count_if({_ACTION} = 'recognise') AS to_recognise FROM {_DOCS} GROUP BY 1""")
def _(spark, d):
    image = F.coalesce(F.col("media").like("image/%"), F.lit(False))
    return documents(spark, d).groupBy("source_id").agg(_n().alias("documents"), F.count_if(image).alias("images"), F.count_if(image & (F.coalesce("content_hash", F.lit("")) != "")).alias("hashed_images"), F.count_if(action() == "recognise").alias("to_recognise"))


@query("ag35_engine_histogram", """SELECT engine, CASE WHEN blocked THEN 'blocked' WHEN coalesce(error, '') <> '' THEN 'error' WHEN trim(coalesce(body_text, '')) = '' THEN 'empty' ELSE 'ok' END AS status, count(*) AS n FROM detail_pages GROUP BY ALL""")
def _(spark, d):
    status = F.when(F.col("blocked"), "blocked").when(F.coalesce("error", F.lit("")) != "", "error").when(F.trim(F.coalesce("body_text", F.lit(""))) == "", "empty").otherwise("ok")
    return table(spark, d, "detail_pages").groupBy("engine", status.alias("status")).agg(_n().alias("n"))


@query("pf14_detail_verdicts", """SELECT page_id, CASE WHEN max(blocked) THEN 'blocked' WHEN max(coalesce(error, '')) <> '' THEN 'failed' WHEN max((heading IS NOT NULL)::INT + (trim(coalesce(body_text, '')) <> '')::INT) = 2 THEN 'detail' WHEN max((heading IS NOT NULL)::INT + (trim(coalesce(body_text, '')) <> '')::INT) = 1 THEN 'partial' ELSE 'empty' END AS verdict FROM detail_pages GROUP BY 1""")
def _(spark, d):
    """A fetched page by its number of fields and whether it was blocked or failed."""
    fields = F.col("heading").isNotNull().cast("int") + (F.trim(F.coalesce("body_text", F.lit(""))) != "").cast("int")
    p = table(spark, d, "detail_pages").groupBy("page_id").agg(F.max("blocked").alias("b"), F.max(F.coalesce("error", F.lit(""))).alias("e"), F.max(fields).alias("f"))
    return p.select("page_id", F.when(F.col("b"), "blocked").when(F.col("e") != "", "failed").when(F.col("f") == 2, "detail").when(F.col("f") == 1, "partial").otherwise("empty").alias("verdict"))


#: Candidates kept of a result, and hits beyond which it is too broad.
CANDIDATES, BROAD = 10, 50


@query("pf12_result_fallbacks", f"""SELECT source_id, CASE WHEN status = 'error' THEN 'error' WHEN status = 'blocked' THEN 'blocked_or_dynamic' WHEN coalesce(h, 0) <= 0 THEN 'no_results' WHEN h > {BROAD} THEN 'too_broad' WHEN h > {CANDIDATES} THEN 'candidate_results_truncated' ELSE 'candidate_results' END AS verdict, count(*) AS n, CAST(sum(least(links, {CANDIDATES})) AS BIGINT) AS links
 FROM (SELECT r.source_id, r.status, r.h, coalesce(l.links, 0) AS links FROM (SELECT id, min(source_id) AS source_id, min(lower(status)) AS status, max(CAST(json_extract_string(payload_json, '$.hit_count') AS BIGINT)) AS h FROM source_results GROUP BY 1) r LEFT JOIN (SELECT result_id, count(DISTINCT hit_id) AS links FROM search_hits GROUP BY 1) l ON l.result_id = r.id) GROUP BY 1, 2""")
def _(spark, d):
    """The verdict on a result that no rule decides, and how many of its links are kept; links are counted before they meet results."""
    r = table(spark, d, "source_results").groupBy("id").agg(F.min("source_id").alias("source_id"), F.min(F.lower("status")).alias("status"), F.max(F.get_json_object("payload_json", "$.hit_count").cast("long")).alias("h"))
    links = table(spark, d, "search_hits").groupBy(F.col("result_id").alias("id")).agg(F.countDistinct("hit_id").alias("links"))
    h, s = F.coalesce("h", F.lit(0)), F.col("status")
    verdict = F.when(s == "error", "error").when(s == "blocked", "blocked_or_dynamic").when(h <= 0, "no_results").when(h > BROAD, "too_broad").when(h > CANDIDATES, "candidate_results_truncated").otherwise("candidate_results")
    return r.join(links, "id", "left").groupBy("source_id", verdict.alias("verdict")).agg(_n().alias("n"), F.sum(F.least(F.coalesce("links", F.lit(0)), F.lit(CANDIDATES))).alias("links"))


@query("sc22_longest_hits", """SELECT result_id, title_key, hit_id FROM (SELECT result_id, lower(trim(title)) AS title_key, hit_id, row_number() OVER (PARTITION BY result_id, lower(trim(title)) ORDER BY length(coalesce(snippet, '')) + length(coalesce(content, '')) DESC, hit_id) AS rn FROM (SELECT DISTINCT * FROM search_hits) WHERE trim(coalesce(title, '')) <> '' AND result_id IS NOT NULL) WHERE rn = 1""")
def _(spark, d):
    """Of a result's hits with one title, the one with the longest text."""
    t = table(spark, d, "search_hits").distinct().filter((F.trim(F.coalesce("title", F.lit(""))) != "") & F.col("result_id").isNotNull())
    n = F.length(F.coalesce("snippet", F.lit(""))) + F.length(F.coalesce("content", F.lit("")))
    best = t.groupBy("result_id", F.lower(F.trim("title")).alias("title_key")).agg(F.min(F.struct((-n).alias("n"), "hit_id")).alias("m"))
    return best.select("result_id", "title_key", "m.hit_id")


_ENABLED = "(SELECT DISTINCT unnest(from_json(source_ids_json, '[\"VARCHAR\"]')) AS source_id FROM search_runs WHERE source_ids_json IS NOT NULL AND json_valid(source_ids_json))"


@query("sc03_enabled_sources", f"SELECT coalesce(e.source_id, s.source_id) AS source_id, CASE WHEN e.source_id IS NULL THEN 'not_enabled' WHEN s.source_id IS NULL THEN 'unresolved' ELSE 'selected' END AS state FROM {_ENABLED} e FULL JOIN (SELECT DISTINCT source_id FROM source_documents WHERE source_id IS NOT NULL) s ON e.source_id = s.source_id")
def _(spark, d):
    """Sources that runs enable against those that are registered: selected, unresolved, not enabled."""
    e = table(spark, d, "search_runs").select(F.explode(F.from_json("source_ids_json", "array<string>")).alias("source_id")).distinct().withColumn("e", F.lit(True))
    s = table(spark, d, "source_documents").select("source_id").filter("source_id is not null").distinct().withColumn("s", F.lit(True))
    state = F.when(F.col("e").isNull(), "not_enabled").when(F.col("s").isNull(), "unresolved").otherwise("selected")
    return e.join(s, "source_id", "full_outer").select("source_id", state.alias("state"))


_VARS = """(SELECT DISTINCT id, nullif(trim(given_name), '') AS given, nullif(trim(family_name), '') AS family, substr(nullif(trim(given_name), ''), 1, 1) AS initial, nullif(regexp_extract(json_extract_string(payload_json, '$.birth_date'), '(1[89][0-9]{2})', 1), '') AS born, nullif(regexp_extract(json_extract_string(payload_json, '$.death_date'), '(1[89][0-9]{2})', 1), '') AS died FROM person_queries)"""


def variables(spark, d):
    """The variables of search templates for each queried person; what isn't known is null."""
    v = lambda c: F.nullif(F.trim(c), F.lit(""))
    year = lambda k: F.nullif(F.regexp_extract(F.get_json_object("payload_json", f"$.{k}"), r"(1[89][0-9]{2})", 1), F.lit(""))
    return table(spark, d, "person_queries").select("id", v("given_name").alias("given"), v("family_name").alias("family"), F.substring(v("given_name"), 1, 1).alias("initial"), year("birth_date").alias("born"), year("death_date").alias("died")).distinct()


@query("f16_template_variables", f"SELECT * FROM {_VARS}")
def _(spark, d):
    return variables(spark, d)


TEMPLATES = [Template("full", "{given} {family}"), Template("register", "{family} {given} {born}"), Template("initial", "{family} {initial}."), Template("dead", "{family} {died}", unless=("born",)), Template("surname", "{family}")]
#: Attempts per person at most.
ATTEMPTS = 3


@query(
    "f17_search_attempts",
    f"""SELECT id, pos - 1 AS pos, a[pos][1] AS template, a[pos][2] AS query FROM (SELECT id, a, unnest(range(1, least(len(a), {ATTEMPTS}) + 1)) AS pos FROM (SELECT id, list_filter([CASE WHEN given IS NOT NULL AND family IS NOT NULL THEN ['full', given || ' ' || family] END, CASE WHEN family IS NOT NULL AND given IS NOT NULL AND born IS NOT NULL THEN ['register', family || ' ' || given || ' ' || born] END,
    CASE WHEN family IS NOT NULL AND initial IS NOT NULL THEN ['initial', family || ' ' || initial || '.'] END, CASE WHEN family IS NOT NULL AND died IS NOT NULL AND born IS NULL THEN ['dead', family || ' ' || died] END, CASE WHEN family IS NOT NULL THEN ['surname', family] END], lambda x: x IS NOT NULL) AS a FROM {_VARS}))""",
)
def _(spark, d):
    """Search attempts of each person from conditional templates, the first few in order."""
    v = variables(spark, d)
    return v.select("id", F.posexplode(attempts(TEMPLATES, ATTEMPTS)).alias("pos", "a")).select("id", F.col("pos").cast("long").alias("pos"), "a.template", "a.query")


@query("u09_grave_attempts", f"SELECT DISTINCT family, initial, CASE WHEN initial IS NULL THEN family ELSE family || ' ' || initial END AS query, died FROM {_VARS} WHERE family IS NOT NULL AND (died IS NULL OR died BETWEEN '1939' AND '1947')")
def _(spark, d):
    """Attempts by surname and initial for those who may have died in the war."""
    v = variables(spark, d).filter("family is not null AND (died is null OR died BETWEEN '1939' AND '1947')")
    return v.select("family", "initial", F.concat_ws(" ", "family", "initial").alias("query"), "died").distinct()


@query("r52_default_queries", "SELECT DISTINCT caduto_id, trim(regexp_replace(concat_ws(' ', nome, nullif(regexp_extract(nascita, '(1[89][0-9]{2})', 1), '')), ' +', ' ', 'g')) AS query FROM caduti WHERE nome IS NOT NULL")
def _(spark, d):
    year = F.nullif(F.regexp_extract("nascita", "(1[89][0-9]{2})", 1), F.lit(""))
    return table(spark, d, "caduti").filter("nome is not null").select("caduto_id", F.trim(F.regexp_replace(F.concat_ws(" ", "nome", year), " +", " ")).alias("query")).distinct()


@query("g25_profile_rows", """SELECT DISTINCT id, 'profile-' || substr(sha256(lower(trim(full_name)) || '|' || coalesce(json_extract_string(payload_json, '$.birth_date'), '')), 1, 16) AS profile_id, trim(full_name) AS name FROM person_queries WHERE trim(coalesce(full_name, '')) <> ''""")
def _(spark, d):
    """A profile row for each query, its id a hash of what it says."""
    p = table(spark, d, "person_queries").filter(F.trim(F.coalesce("full_name", F.lit(""))) != "")
    key = F.concat(F.lower(F.trim("full_name")), F.lit("|"), F.coalesce(F.get_json_object("payload_json", "$.birth_date"), F.lit("")))
    return p.select("id", F.concat(F.lit("profile-"), F.substring(F.sha2(key, 256), 1, 16)).alias("profile_id"), F.trim("full_name").alias("name")).distinct()


@query("f02_latin_words", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(title), '[a-zà-öø-ÿ]+')) AS word FROM source_documents) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "source_documents").select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit("[a-zà-öø-ÿ]+"), F.lit(0))).alias("word")).groupBy("word").agg(_n().alias("n"))


@query("f04_mark_tokens", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+')) AS tokens, len(list_distinct(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+'))) AS different FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    """Tokens of letters, digits and the marks that combine with them."""
    t = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("different"))


# Spellings of kinds of unit, by canonical form.
UNITS = [(r"\b(?:btg|batt)\.?\b", "battaglione"), (r"\b(?:brg|brig|bgt)\.?\b", "brigata"), (r"\b(?:rgt|reg)\.?\b", "reggimento"), (r"\b(?:div)\.?\b", "divisione"), (r"\b(?:cp|comp)\.?\b", "compagnia")]


def _unit_sql(c: str) -> str:
    c = f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
    for p, full in UNITS:
        c = f"regexp_replace({c}, '{p}', '{full}', 'g')"
    return c


@query("f07_unit_names", f"SELECT {_unit_sql('ruolo_affiliazione')} AS unit, count(*) AS n FROM caduti WHERE ruolo_affiliazione IS NOT NULL GROUP BY 1")
def _(spark, d):
    """Roles and units with blanks squeezed and abbreviated kinds written out."""
    c = F.trim(F.regexp_replace(F.lower("ruolo_affiliazione"), r"\s+", " "))
    for p, full in UNITS:
        c = F.regexp_replace(c, p, full)
    return table(spark, d, "caduti").filter("ruolo_affiliazione is not null").groupBy(c.alias("unit")).agg(_n().alias("n"))


_FAMILIES = {"date": r"1[89][0-9]{2}", "place": r"\b(?:Monte|Borgo|Rocca|Ponte|Pieve|Castel|San)\b", "unit": r"«[^»]+»|\b(?:colonna|reparto|brigata|Kompanie|column|section)\b"}
_SENT = r"(SELECT doc_id, trim(unnest(string_split_regex(regexp_replace(text, '([.!?…]) +', '\1' || chr(10), 'g'), '\n+'))) AS s FROM documents WHERE text IS NOT NULL)"
_HITS = " + ".join(f"regexp_matches(s, '{p}')::INT" for p in _FAMILIES.values())


@query("f27_signal_segments", f"SELECT doc_id, signals, count(*) AS segments, round(least(0.82::DOUBLE, max(CASE WHEN regexp_matches(s, '{_FAMILIES['date']}') THEN 0.72 WHEN regexp_matches(s, '{_FAMILIES['place']}') THEN 0.68 ELSE 0.60 END) + 0.06 * (signals - 1)), 6) AS score FROM (SELECT doc_id, s, {_HITS} AS signals FROM {_SENT} WHERE s <> '') WHERE signals > 0 GROUP BY doc_id, signals")
def _(spark, d):
    """Sentences by the families of signals in them: the best family's confidence, more for several, at most 0.82."""
    from ..operators.documents import sentences

    s = sentences(table(spark, d, "documents").filter("text is not null"), "doc_id", "text")
    has = {k: F.col("sentence").rlike(p) for k, p in _FAMILIES.items()}
    s = s.withColumn("signals", sum((h.cast("int") for h in has.values()), F.lit(0))).filter("signals > 0")
    base = F.when(has["date"], 0.72).when(has["place"], 0.68).otherwise(0.60)
    out = s.groupBy("doc_id", "signals").agg(_n().alias("segments"), F.max(base).alias("b"))
    return out.select("doc_id", "signals", "segments", F.round(F.least(F.lit(0.82), F.col("b") + 0.06 * (F.col("signals") - 1)), 6).alias("score"))


@query("f10_plain_keys", f"SELECT k, count(*) AS n FROM (SELECT trim(regexp_replace(translate(lower(title), '{T.ACCENTS[0]}ºª°', '{T.ACCENTS[1]}'), '[^a-z0-9]+', ' ', 'g')) AS k FROM source_documents WHERE title IS NOT NULL) GROUP BY 1")
def _(spark, d):
    """Titles without accents, ordinal marks and punctuation."""
    k = F.trim(F.regexp_replace(F.translate(F.lower("title"), T.ACCENTS[0] + "ºª°", T.ACCENTS[1]), "[^a-z0-9]+", " "))
    return table(spark, d, "source_documents").filter("title is not null").groupBy(k.alias("k")).agg(_n().alias("n"))


@query("f13_related_names", r"""SELECT caduto_id, name, count(*) AS n FROM (SELECT caduto_id, nome, unnest(regexp_extract_all(profilo_biografico, '\b([A-ZÀ-Ý][a-zà-ÿ]+ [A-ZÀ-Ý][a-zà-ÿ]+)\b', 1)) AS name FROM (SELECT DISTINCT caduto_id, nome, profilo_biografico FROM caduti WHERE profilo_biografico IS NOT NULL)) WHERE lower(name) <> lower(coalesce(nome, '')) GROUP BY 1, 2""")
def _(spark, d):
    """Pairs of capitalised words in a biography that aren't the person's own name."""
    t = table(spark, d, "caduti").filter("profilo_biografico is not null").select("caduto_id", "nome", "profilo_biografico").distinct()
    names = t.select("caduto_id", "nome", F.explode(F.regexp_extract_all("profilo_biografico", F.lit(r"\b([A-ZÀ-Ý][a-zà-ÿ]+ [A-ZÀ-Ý][a-zà-ÿ]+)\b"), F.lit(1))).alias("name"))
    return names.filter(F.lower("name") != F.lower(F.coalesce("nome", F.lit("")))).groupBy("caduto_id", "name").agg(_n().alias("n"))


@query("f37_string_lists", "SELECT run_id, s AS source_id FROM (SELECT DISTINCT run_id, unnest(list_filter(list_transform(from_json(source_ids_json, '[\"VARCHAR\"]'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM search_runs WHERE source_ids_json IS NOT NULL AND json_valid(source_ids_json))")
def _(spark, d):
    """The strings of a JSON list; anything else in it, and blanks, are left out."""
    v = F.filter(F.transform(F.from_json("source_ids_json", "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, d, "search_runs").select("run_id", F.explode(v).alias("source_id")).distinct()


@query("f38_payload_hashes", "SELECT sha256(k) AS h, count(*) AS n FROM (SELECT array_to_string(list_sort(list_transform(json_keys(payload_json), lambda x: x || '=' || coalesce(json_extract_string(payload_json, '$.' || x), ''))), chr(10)) AS k FROM person_queries WHERE payload_json IS NOT NULL AND json_valid(payload_json)) GROUP BY 1")
def _(spark, d):
    """A hash of a payload that doesn't depend on the order of its keys."""
    m = F.from_json("payload_json", "map<string,string>")
    parts = F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return table(spark, d, "person_queries").filter("payload_json is not null").groupBy(F.sha2(F.array_join(parts, "\n"), 256).alias("h")).agg(_n().alias("n"))


QUERIES, SQL = query.QUERIES, query.SQL
