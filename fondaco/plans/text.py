"""Queries over texts: normal forms, languages, chunks, mentions, similarity, matching of labels and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.documents import boundary_chunks, components, mentions, sentences, stride_chunks, tfidf, tfidf_pairs
from ..operators.relational import hash_id, unique_match
from ..session import cut, table
from .base import Registry

query = Registry()


def _n():
    return F.count(F.lit(1))


_PLAIN = f"translate(lower({{}}), '{T.ACCENTS[0]}', '{T.ACCENTS[1]}')"
_LABEL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[-\\x{{2010}}-\\x{{2015}}]', ' ', 'g'), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' +', ' ', 'g'))"


@query("f01_latin_tokens", f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_PLAIN.format('title')}, '[a-z0-9]{{3,}}')) AS term FROM source_documents) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_documents").select(F.explode(T.latin_tokens("title")).alias("term")).groupBy("term").agg(_n().alias("n"))


@query("f03_word_tokens", r"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").select(F.explode(T.word_tokens("text")).alias("term")).groupBy("term").agg(_n().alias("n"))


@query("f05_label_forms", f"SELECT DISTINCT matched_label, {_LABEL.format('matched_label')} AS form FROM place_labels WHERE matched_label IS NOT NULL")
def _(spark, d):
    return table(spark, d, "place_labels").filter("matched_label is not null").select("matched_label", T.label_form("matched_label").alias("form")).distinct()


@query("f11_order_free_names", f"SELECT array_to_string(list_sort(string_split({_LABEL.format('full_name')}, ' ')), ' ') AS name_key, count(*) AS n FROM person_queries WHERE full_name IS NOT NULL GROUP BY 1")
def _(spark, d):
    return table(spark, d, "person_queries").filter("full_name is not null").groupBy(T.order_free("full_name").alias("name_key")).agg(_n().alias("n"))


_MONTH_CASE = "CASE regexp_extract(lower({0}), '([0-9]{{1,2}}) (" + "|".join(T.MONTHS_IT) + ") (1[89][0-9]{{2}}|20[0-9]{{2}})', 2) " + " ".join(f"WHEN '{m}' THEN '{i:02d}'" for i, m in enumerate(T.MONTHS_IT, 1)) + " END"


def _iso_sql(c: str) -> str:
    iso, num = "(1[89][0-9]{2}|20[0-9]{2})-([0-9]{2})-([0-9]{2})", "([0-9]{1,2})[./]([0-9]{1,2})[./](1[89][0-9]{2}|20[0-9]{2})"
    word = "([0-9]{1,2}) (" + "|".join(T.MONTHS_IT) + ") (1[89][0-9]{2}|20[0-9]{2})"
    x = lambda p, g: f"regexp_extract(lower({c}), '{p}', {g})"
    return f"""CASE WHEN {x(iso, 0)} <> '' THEN {x(iso, 0)} WHEN {x(num, 0)} <> '' THEN {x(num, 3)} || '-' || lpad({x(num, 2)}, 2, '0') || '-' || lpad({x(num, 1)}, 2, '0')
    WHEN {x(word, 0)} <> '' THEN {x(word, 3)} || '-' || {_MONTH_CASE.format(c)} || '-' || lpad({x(word, 1)}, 2, '0') END"""


@query("f14_iso_dates", f"SELECT DISTINCT caduto_id, {_iso_sql('nascita')} AS born, {_iso_sql('morte')} AS died FROM caduti")
def _(spark, d):
    return table(spark, d, "caduti").select("caduto_id", T.iso_date("nascita").alias("born"), T.iso_date("morte").alias("died")).distinct()


@query("f15_first_years", "SELECT nullif(regexp_extract(title, '(?:^|[^0-9])(1[89][0-9]{2}|20[0-9]{2})(?:[^0-9]|$)', 1), '') AS year, count(*) AS n FROM source_documents GROUP BY 1")
def _(spark, d):
    return table(spark, d, "source_documents").groupBy(T.first_year("title").alias("year")).agg(_n().alias("n"))


@query("f21_name_parts", "SELECT DISTINCT candidate_id, split_part(trim(canonical_name), ' ', 1) AS first_part, regexp_replace(trim(canonical_name), '^\\S+\\s*', '') AS rest FROM profile_names WHERE canonical_name IS NOT NULL")
def _(spark, d):
    t = F.trim("canonical_name")
    return table(spark, d, "profile_names").filter("canonical_name is not null").select("candidate_id", F.split_part(t, F.lit(" "), F.lit(1)).alias("first_part"), F.regexp_replace(t, r"^\S+\s*", "").alias("rest")).distinct()


@query("f22_slugs", f"SELECT place_id, regexp_replace(regexp_replace({_PLAIN.format('preferred_label')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM places")
def _(spark, d):
    return table(spark, d, "places").select("place_id", T.slug("preferred_label").alias("slug"))


@query("f24_token_counts", "SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS tokens FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("long").alias("tokens"))


@query("f25_contexts", rf"""SELECT doc_id, start, substr(text, greatest(start - 80, 1), 160) AS around FROM (SELECT doc_id, text, 1 + length(list_aggregate(p[1:i], 'string_agg', '')) + 4 * (i - 1) AS start FROM (SELECT doc_id, text, p, unnest(range(1, len(p))) AS i FROM (SELECT doc_id, text, string_split_regex(text, '1[89][0-9][0-9]') AS p FROM documents WHERE text IS NOT NULL)))""")
def _(spark, d):
    """The 80 characters on both sides of every year in a text, with its position (from 1)."""
    p = F.split("text", "1[89][0-9][0-9]")
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", "text", p.alias("p"))
    starts = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: 1 + F.length(F.array_join(F.slice("p", 1, i), "")) + 4 * (i - 1))
    t = t.filter(F.size("p") > 1).select("doc_id", "text", F.explode(starts).alias("start"))
    return t.select("doc_id", F.col("start").cast("long").alias("start"), F.substr("text", F.greatest(F.col("start") - 80, F.lit(1)), F.lit(160)).alias("around"))


def _score_sql(lang: str) -> str:
    marks = "[" + ", ".join(f"'{m}'" for m in T.MARKERS[lang]) + "]"
    return f"(len(list_filter(t, lambda x: list_contains({marks}, x))) + 2 * len(list_intersect({marks}, t)))"


_SCORES = "SELECT doc_id, chars, " + ", ".join(f"{_score_sql(k)} AS {k}" for k in T.MARKERS) + r" FROM (SELECT doc_id, length(trim(text)) AS chars, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE text IS NOT NULL)"
_KS = ", ".join(T.MARKERS)


@query("f28_language_scores", f"SELECT doc_id, {_KS} FROM ({_SCORES})")
def _(spark, d):
    return language_scores(spark, d).drop("chars")


def language_scores(spark, d):
    """Scores of each language; a text is cut in tokens once for all of them."""
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.length(F.trim("text")).alias("chars"), T.word_tokens("text").alias("t"))
    return t.select("doc_id", "chars", *[T.marker_score("t", k).cast("long").alias(k) for k in T.MARKERS])


_TOP, _TOTAL = f"greatest({_KS})", f"({_KS.replace(', ', ' + ')})"


@query(
    "g08_languages",
    f"""SELECT doc_id, CASE WHEN {_TOP} = 0 OR chars < {T.MARKED_CHARS} THEN 'und' ELSE list_sort([{', '.join(f"{{'s': -{k}, 'k': '{k}'}}" for k in T.MARKERS)}])[1].k END AS language,
    round(least(CASE WHEN chars < {T.MARKED_CHARS} THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END, CASE WHEN {_TOP} = 0 THEN 0.15::DOUBLE ELSE greatest(0.25::DOUBLE, least(0.99::DOUBLE, 0.65::DOUBLE * {_TOP} / {_TOTAL} + 0.35::DOUBLE * ({_TOP} - list_sort([{_KS}])[3]) / {_TOP})) END), 9) AS confidence,
    chars >= {T.MARKED_CHARS} AND len(list_filter([{_KS}], lambda x: x >= greatest(2, floor(0.45 * {_TOP})))) > 1 AS multilingual FROM ({_SCORES})""",
)
def languages(spark, d):
    """Language by marker words: the share of the best and its margin over the next; short texts and those without a marker stay undetermined."""
    s = language_scores(spark, d)
    ks = list(T.MARKERS)
    scores = F.array(*[F.col(k) for k in ks])
    top, total = F.array_max(scores), F.aggregate(scores, F.lit(0).cast("long"), lambda a, x: a + x)
    second = F.element_at(F.array_sort(scores), len(ks) - 1)
    best = F.element_at(F.array_sort(F.array(*[F.struct((-F.col(k)).alias("s"), F.lit(k).alias("k")) for k in ks])), 1)["k"]
    short = F.col("chars") < T.MARKED_CHARS
    conf = F.when(top == 0, 0.15).otherwise(F.greatest(F.lit(0.25), F.least(F.lit(0.99), 0.65 * top / total + 0.35 * (top - second) / top)))
    many = F.size(F.filter(scores, lambda x: x >= F.greatest(F.lit(2.0), F.floor(0.45 * top)))) > 1
    return s.select("doc_id", F.when((top == 0) | short, "und").otherwise(best).alias("language"), F.round(F.least(F.when(short, 0.2).otherwise(1.0), conf), 9).alias("confidence"), (~short & many).alias("multilingual"))


@query("g09_routing", f"SELECT language, multilingual OR confidence < 0.45 AS manual_review, count(*) AS n FROM ({query.SQL['g08_languages']}) GROUP BY ALL")
def _(spark, d):
    return languages(spark, d).groupBy("language", (F.col("multilingual") | (F.col("confidence") < 0.45)).alias("manual_review")).agg(_n().alias("n"))


@query("f31_scripts", r"""SELECT doc_id, CASE WHEN c = 0 AND l = 0 THEN 'none' WHEN c > l THEN 'cyrillic' ELSE 'latin' END AS script FROM (SELECT doc_id, length(regexp_replace(text, '[^\p{Cyrillic}]', '', 'g')) AS c, length(regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g')) AS l FROM documents WHERE text IS NOT NULL)""")
def _(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.script("text").alias("script"))


@query("f32_edit_distances", "SELECT DISTINCT candidate_id, levenshtein(lower(canonical_name), lower(matched_name)) AS edits FROM profile_names WHERE canonical_name IS NOT NULL AND matched_name IS NOT NULL AND levenshtein(lower(canonical_name), lower(matched_name)) <= 3")
def _(spark, d):
    x = T.levenshtein_within(F.lower("canonical_name"), F.lower("matched_name"), 3)
    return table(spark, d, "profile_names").select("candidate_id", x.cast("long").alias("edits")).filter("edits is not null").distinct()


@query("f33_json_maps", "SELECT k, count(*) AS n FROM (SELECT unnest(json_keys(payload_json)) AS k FROM person_queries WHERE payload_json IS NOT NULL AND json_valid(payload_json)) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "person_queries").select(F.explode(F.json_object_keys("payload_json")).alias("k")).groupBy("k").agg(_n().alias("n"))


@query("f34_confidence", "SELECT candidate_id, max(CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.25 ELSE greatest(0.0, least(1.0, confidence)) END) AS score FROM profile_names GROUP BY 1")
def _(spark, d):
    c = F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0.25).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")))
    return table(spark, d, "profile_names").groupBy("candidate_id").agg(F.max(c).alias("score"))


@query(
    "g01_stride_chunks",
    """SELECT doc_id, i AS chunk_index, i * 900 AS char_start, least(i * 900 + 1000, length(text)) AS char_end, 'chunk-' || substr(sha256(CAST(doc_id AS VARCHAR) || '|' || CAST(i AS VARCHAR) || '|' || substr(text, i * 900 + 1, 1000)), 1, 16) AS chunk_id
    FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 100) / 900.0), 1) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)""",
)
def _(spark, d):
    c = stride_chunks(table(spark, d, "documents"), "doc_id", "text")
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), hash_id("chunk-", "doc_id", "chunk_index", "chunk").alias("chunk_id"))


@query("g01_boundary_chunks")
def _(spark, d):
    return boundary_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("g02_sentences", r"""SELECT count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars, count(DISTINCT s) AS different FROM (SELECT trim(unnest(string_split_regex(regexp_replace(text, '([.!?…]) +', '\1' || chr(10), 'g'), '\n+'))) AS s FROM documents) WHERE s <> ''""")
def _(spark, d):
    return sentences(table(spark, d, "documents"), "doc_id", "text").agg(_n().alias("n"), F.sum(F.length("sentence")).alias("chars"), F.countDistinct("sentence").alias("different"))


RULES = {"year": r"\b(1[89][0-9]{2})\b", "date_it": r"\b([0-9]{1,2} (?:" + "|".join(T.MONTHS_IT) + r") 1[89][0-9]{2})\b", "folder": r"\b((?:busta|fascicolo|cartella|Mappe|Karton|folder|box) [0-9]+)\b", "unit": r"«([^»]{2,40})»"}


@query("g03_mentions", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, v AS value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 1)) AS v FROM documents) GROUP BY ALL" for k, p in RULES.items()))
def document_mentions(spark, d):
    return mentions(table(spark, d, "documents"), "doc_id", "text", RULES)


@query("g06_entities", f"SELECT kind, value, count(*) AS documents, CAST(sum(n) AS BIGINT) AS n FROM ({query.SQL['g03_mentions']}) GROUP BY ALL")
def _(spark, d):
    return document_mentions(spark, d).groupBy("kind", "value").agg(_n().alias("documents"), F.sum("n").alias("n"))


@query("j16_shared_mentions", f"""SELECT a.value AS unit, b.value AS year, count(*) AS documents FROM ({query.SQL['g03_mentions']}) a JOIN ({query.SQL['g03_mentions']}) b ON a.doc_id = b.doc_id AND a.kind = 'unit' AND b.kind = 'year' GROUP BY ALL""")
def _(spark, d):
    m = document_mentions(spark, d)
    a, b = m.filter("kind = 'unit'").select("doc_id", F.col("value").alias("unit")), m.filter("kind = 'year'").select("doc_id", F.col("value").alias("year"))
    return a.join(b, "doc_id").groupBy("unit", "year").agg(_n().alias("documents"))


@query(
    "g11_tfidf",
    f"""SELECT term, count(*) AS docs, round(max(tf * (ln((1 + nd) / (1.0 + df)) + 1)), 4) AS most FROM (SELECT document_id, term, count(*) AS tf, count(*) OVER (PARTITION BY term) AS df FROM
    (SELECT document_id, unnest(regexp_extract_all({_PLAIN.format('title')}, '[a-z0-9]{{3,}}')) AS term FROM (SELECT DISTINCT document_id, title FROM source_documents)) GROUP BY 1, 2),
    (SELECT count(DISTINCT document_id) AS nd FROM source_documents WHERE len(regexp_extract_all({_PLAIN.format('title')}, '[a-z0-9]{{3,}}')) > 0) GROUP BY 1""",
)
def _(spark, d):
    t = table(spark, d, "source_documents").select("document_id", "title").distinct().select("document_id", F.explode(T.latin_tokens("title")).alias("term"))
    return tfidf(t, "document_id").groupBy("term").agg(_n().alias("docs"), F.round(F.max("w"), 4).alias("most"))


# Similarity, least number of tokens and stop words of text clusters.
CLUSTER, CLUSTER_TOKENS = 0.86, 80
CLUSTER_STOP = "alla alle che chi come con dei del della delle dello dopo era gli ill nel nella nelle non per piu sul sulla tra una".split()


def text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Different texts of enough tokens whose TF-IDF cosine reaches the threshold; equal texts are one class, named by its smallest id, and meet once."""
    stop = F.array(*[F.lit(w) for w in CLUSTER_STOP])
    # a shorter text has no room for so many tokens of three characters and what parts them
    t = table(spark, d, "documents").filter(F.length(F.lower("text")) >= 4 * CLUSTER_TOKENS - 1).groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    t = t.select("doc_id", F.filter(T.latin_tokens("text"), lambda w: ~F.array_contains(stop, w)).alias("t"))
    return tfidf_pairs(t, "doc_id", "t", CLUSTER, CLUSTER_TOKENS)


_CLUSTERED = f"""WITH t AS (SELECT min(doc_id) AS doc_id, list_filter(regexp_extract_all({_PLAIN.format('text')}, '[a-z0-9]{{3,}}'), lambda w: NOT list_contains([{', '.join(f"'{w}'" for w in CLUSTER_STOP)}], w)) AS t FROM documents WHERE text IS NOT NULL GROUP BY text),
 o AS (SELECT doc_id, unnest(t) AS term FROM t WHERE len(t) >= {CLUSTER_TOKENS}), f AS (SELECT doc_id, term, count(*) AS tf FROM o GROUP BY 1, 2),
 w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(DISTINCT doc_id) FROM f)) / (1.0 + count(*) OVER (PARTITION BY term))) + 1) AS w FROM f), u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= {CLUSTER})"""


@query("g12_similar_texts", _CLUSTERED + " SELECT a, b, round(cosine, 4) AS cosine FROM p")
def _(spark, d):
    return text_pairs(spark, d).select("a", "b", F.round("cosine", 4).alias("cosine"))


@query(
    "g14_text_clusters",
    _CLUSTERED.replace("WITH t", "WITH RECURSIVE t") + ", e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), r AS (SELECT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), m AS (SELECT x AS node, min(y) AS component FROM r GROUP BY 1)"
    " SELECT component, max(members) AS members, round(min(cosine), 4) AS least, round(max(cosine), 4) AS most, round(avg(cosine), 4) AS mean FROM (SELECT m.component, count(*) OVER (PARTITION BY m.component) AS k, p.cosine, (SELECT count(*) FROM m n WHERE n.component = m.component) AS members FROM p JOIN m ON m.node = p.a) GROUP BY 1",
)
def _(spark, d):
    """Clusters of similar texts with their size and the least, greatest and mean similarity of their pairs."""
    pairs = cut(text_pairs(spark, d))
    c = components(pairs)
    size = c.groupBy("component").agg(_n().alias("members"))
    stats = pairs.join(c.withColumnRenamed("node", "a"), "a").groupBy("component").agg(*[F.round(f("cosine"), 4).alias(n) for f, n in ((F.min, "least"), (F.max, "most"), (F.avg, "mean"))])
    return size.join(stats, "component").select("component", "members", "least", "most", "mean")


@query(
    "j06_names_in_register",
    f"""SELECT DISTINCT n.profile_id, c.caduto_id, least(0.88, coalesce(n.confidence, 0.25)) AS score FROM profile_names n JOIN caduti c ON {_LABEL.format('n.matched_name')} = {_LABEL.format('c.nome')} WHERE {_LABEL.format('c.nome')} <> ''""",
)
def _(spark, d):
    n = table(spark, d, "profile_names").select("profile_id", T.label_form("matched_name").alias("k"), F.least(F.lit(0.88), F.coalesce("confidence", F.lit(0.25))).alias("score"))
    c = table(spark, d, "caduti").select("caduto_id", T.label_form("nome").alias("k")).filter("k <> ''")
    return n.join(c, "k").select("profile_id", "caduto_id", "score").distinct()


@query(
    "j09_unique_places",
    f"""SELECT DISTINCT l.candidate_id, coalesce(c.matches, 0) AS matches, CASE WHEN c.matches = 1 THEN c.place_id END AS place_id FROM place_labels l LEFT JOIN (SELECT k, count(DISTINCT place_id) AS matches, min(place_id) AS place_id FROM
    (SELECT place_id, {_LABEL.format('preferred_label')} AS k FROM places UNION ALL SELECT place_id, {_LABEL.format('a')} FROM (SELECT place_id, unnest(alternate_labels) AS a FROM places)) GROUP BY 1) c ON c.k = {_LABEL.format('l.matched_label')}""",
)
def _(spark, d):
    p = table(spark, d, "places")
    catalog = p.select("place_id", T.label_form("preferred_label").alias("k")).unionByName(p.select("place_id", F.explode("alternate_labels").alias("a")).select("place_id", T.label_form("a").alias("k")))
    m = table(spark, d, "place_labels").select("candidate_id", T.label_form("matched_label").alias("k"))
    return unique_match(m, catalog, "k", "place_id").select("candidate_id", "matches", "place_id").distinct()


@query("j08_title_links", """SELECT DISTINCT profile_id, matched_name, is_canonical FROM (SELECT profile_id, matched_name, match_kind = 'canonical_name' AS is_canonical, sum(CASE WHEN match_kind = 'canonical_name' THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id) AS n FROM profile_names) WHERE is_canonical OR n <> 1""")
def _(spark, d):
    # a group sum and a join instead of a window, so that a hot group isn't sorted in one task
    t = table(spark, d, "profile_names").select("profile_id", "matched_name", (F.col("match_kind") == "canonical_name").alias("is_canonical"))
    n = t.groupBy("profile_id").agg(F.count_if("is_canonical").alias("n"))
    return t.join(n, "profile_id").filter("is_canonical OR n <> 1").select("profile_id", "matched_name", "is_canonical").distinct()


@query(
    "j33_existing_or_new",
    f"""SELECT DISTINCT q.id, EXISTS (SELECT 1 FROM profile_names n WHERE array_to_string(list_sort(string_split({_LABEL.format('n.canonical_name')}, ' ')), ' ') = array_to_string(list_sort(string_split({_LABEL.format('q.full_name')}, ' ')), ' ')) AS existing FROM person_queries q WHERE q.full_name IS NOT NULL""",
)
def _(spark, d):
    q = table(spark, d, "person_queries").filter("full_name is not null").select("id", T.order_free("full_name").alias("k")).distinct()
    n = table(spark, d, "profile_names").select(T.order_free("canonical_name").alias("k"), F.lit(True).alias("e")).distinct()
    return q.join(n, "k", "left").select("id", F.coalesce("e", F.lit(False)).alias("existing")).distinct()


@query("j21_either_column", "SELECT DISTINCT q.id, c.caduto_id FROM person_queries q JOIN caduti c ON (q.family_name <> '' AND lower(c.nome) = lower(q.given_name || ' ' || q.family_name)) OR (q.family_name <> '' AND lower(c.nome) = lower(q.family_name || ' ' || q.given_name))")
def _(spark, d):
    q, c = table(spark, d, "person_queries").filter("family_name <> ''"), table(spark, d, "caduti").select("caduto_id", F.lower("nome").alias("k"))
    one = lambda a, b: q.select("id", F.lower(F.concat(a, F.lit(" "), b)).alias("k")).join(c, "k").select("id", "caduto_id")
    return one("given_name", "family_name").unionByName(one("family_name", "given_name")).distinct()


QUERIES, SQL = query.QUERIES, query.SQL
