"""Queries that join, rank and project across the store: plans against outcomes, shared documents, suggestions, balanced picks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators.incremental import set_digest
from ..session import table
from .base import Registry
from .text import _LABEL

query = Registry()


def _n():
    return F.count(F.lit(1))


@query("j10_best_label", """SELECT place_id, arg_max(label, struct_pack(s := score, l := label)) AS label FROM (SELECT place_id, preferred_label AS label, 2 AS score FROM places UNION ALL SELECT place_id, unnest(alternate_labels), 1 FROM places) GROUP BY 1""")
def _(spark, d):
    p = table(spark, d, "places")
    rows = p.select("place_id", F.col("preferred_label").alias("label"), F.lit(2).alias("score")).unionByName(p.select("place_id", F.explode("alternate_labels").alias("label"), F.lit(1).alias("score")))
    return rows.groupBy("place_id").agg(F.max_by("label", F.struct("score", "label")).alias("label"))


@query(
    "j13_single_profile",
    """SELECT normalized_name, count(DISTINCT profile_id) AS profiles, CASE WHEN count(DISTINCT profile_id) = 1 THEN min(profile_id) END AS profile_id, max(coalesce(confidence, 0.25)) AS best FROM profile_names GROUP BY 1""",
)
def _(spark, d):
    g = table(spark, d, "profile_names").groupBy("normalized_name").agg(F.countDistinct("profile_id").alias("profiles"), F.min("profile_id").alias("p"), F.max(F.coalesce("confidence", F.lit(0.25))).alias("best"))
    return g.select("normalized_name", "profiles", F.when(F.col("profiles") == 1, F.col("p")).alias("profile_id"), "best")


_CLAIMS = "(SELECT DISTINCT profile_id, trim(source_document_id) AS doc, candidate_field AS field, candidate_value AS value FROM review_queue_items WHERE profile_id IS NOT NULL AND trim(coalesce(source_document_id, '')) <> '' AND candidate_field IS NOT NULL)"


@query(
    "j22_shared_documents",
    f"""SELECT DISTINCT a.profile_id, b.field, b.value FROM {_CLAIMS} a JOIN {_CLAIMS} b ON a.doc = b.doc AND a.profile_id <> b.profile_id
    WHERE NOT EXISTS (SELECT 1 FROM {_CLAIMS} o WHERE o.profile_id = a.profile_id AND o.field = b.field)""",
)
def _(spark, d):
    """Claims that other profiles hold through a shared document, for fields of which the profile has none."""
    r = table(spark, d, "review_queue_items").filter("profile_id is not null AND candidate_field is not null").filter(F.trim(F.coalesce("source_document_id", F.lit(""))) != "")
    c = r.select("profile_id", F.trim("source_document_id").alias("doc"), F.col("candidate_field").alias("field"), F.col("candidate_value").alias("value")).distinct()
    a = c.select("profile_id", "doc").distinct()
    b = c.select(F.col("profile_id").alias("other"), "doc", "field", "value")
    return a.join(b, "doc").filter("profile_id <> other").select("profile_id", "field", "value").distinct().join(c.select("profile_id", "field").distinct(), ["profile_id", "field"], "left_anti")


@query(
    "j25_queue_and_answers",
    """SELECT CASE WHEN a.item_id IS NULL THEN 'unknown' WHEN b.item_id IS NULL THEN 'pending' ELSE 'answered' END AS state, coalesce(a.item_type, b.item_type) AS item_type, count(*) AS n FROM
    (SELECT item_id, min(item_type) AS item_type FROM review_queue_items WHERE registered_at < TIMESTAMP '2024-01-01' GROUP BY 1) a FULL JOIN (SELECT item_id, min(item_type) AS item_type FROM review_queue_items WHERE registered_at >= TIMESTAMP '2023-06-01' GROUP BY 1) b USING (item_id) GROUP BY ALL""",
)
def _(spark, d):
    r = table(spark, d, "review_queue_items").withColumn("at", F.col("registered_at").cast("timestamp_ntz"))
    when = lambda s: F.lit(s).cast("timestamp_ntz")
    a = r.filter(F.col("at") < when("2024-01-01 00:00:00")).groupBy("item_id").agg(F.min("item_type").alias("ta"), F.lit(True).alias("ha"))
    b = r.filter(F.col("at") >= when("2023-06-01 00:00:00")).groupBy("item_id").agg(F.min("item_type").alias("tb"), F.lit(True).alias("hb"))
    state = F.when(F.col("ha").isNull(), "unknown").when(F.col("hb").isNull(), "pending").otherwise("answered")
    return a.join(b, "item_id", "full_outer").groupBy(state.alias("state"), F.coalesce("ta", "tb").alias("item_type")).agg(_n().alias("n"))


@query(
    "j27_plan_coverage",
    """SELECT p.source_id, count(*) AS planned, count(o.run_id) AS done, round(count(o.run_id) * 1.0::DOUBLE / count(*), 9) AS coverage FROM (SELECT DISTINCT run_id, unnest(from_json(source_ids_json, '["VARCHAR"]')) AS source_id FROM search_runs WHERE source_ids_json IS NOT NULL) p
    LEFT JOIN (SELECT DISTINCT run_id, source_id FROM source_results) o ON o.run_id = p.run_id AND o.source_id = p.source_id GROUP BY 1""",
)
def _(spark, d):
    p = table(spark, d, "search_runs").select("run_id", F.explode(F.from_json("source_ids_json", "array<string>")).alias("source_id")).distinct()
    o = table(spark, d, "source_results").select("run_id", "source_id", F.lit(1).alias("o")).distinct()
    return p.join(o, ["run_id", "source_id"], "left").groupBy("source_id").agg(_n().alias("planned"), F.count("o").alias("done"), F.round(F.count("o") / _n(), 9).alias("coverage"))


@query(
    "g21_results_per_person",
    """SELECT p.id, count(r.id) AS results, count(DISTINCT r.source_id) AS sources FROM (SELECT DISTINCT id, run_id, full_name FROM person_queries WHERE full_name IS NOT NULL) p JOIN (SELECT DISTINCT id, run_id, source_id, query FROM source_results) r ON r.run_id = p.run_id AND r.query = p.full_name GROUP BY 1""",
)
def _(spark, d):
    p = table(spark, d, "person_queries").filter("full_name is not null").select(F.col("id").alias("pid"), "run_id", F.col("full_name").alias("query")).distinct()
    r = table(spark, d, "source_results").select("id", "run_id", "source_id", "query").distinct()
    return p.join(r, ["run_id", "query"]).groupBy(F.col("pid").alias("id")).agg(F.count("id").alias("results"), F.countDistinct("source_id").alias("sources"))


@query(
    "t05_staged_caps",
    """SELECT profile_id, item_id, rn FROM (SELECT profile_id, item_id, row_number() OVER (PARTITION BY profile_id ORDER BY ord, item_id) AS rn FROM (SELECT profile_id, item_id, ord, row_number() OVER (PARTITION BY profile_id, item_type, coalesce(candidate_field, '') ORDER BY item_id) AS g, row_number() OVER (PARTITION BY profile_id, item_type ORDER BY item_id) AS t, item_type
    FROM (SELECT DISTINCT profile_id, item_id, item_type, candidate_field, CASE item_type WHEN 'link' THEN 0 ELSE 1 END AS ord FROM review_queue_items WHERE profile_id IS NOT NULL)) WHERE CASE WHEN item_type = 'link' THEN t <= 5 ELSE g <= 3 END) WHERE rn <= 10""",
)
def _(spark, d):
    """Of each profile at most five links and three items of each other group, ten at all, links first (a report's caps)."""
    r = table(spark, d, "review_queue_items").filter("profile_id is not null").select("profile_id", "item_id", "item_type", "candidate_field").distinct()
    pos = lambda *by: F.row_number().over(Window.partitionBy("profile_id", *by).orderBy("item_id"))
    link = F.coalesce(F.col("item_type") == "link", F.lit(False))
    r = r.withColumn("f", F.coalesce("candidate_field", F.lit(""))).withColumn("g", pos("item_type", "f")).withColumn("t", pos("item_type"))
    kept = r.filter(F.when(link, F.col("t") <= 5).otherwise(F.col("g") <= 3)).withColumn("ord", F.when(link, 0).otherwise(1))
    return kept.withColumn("rn", F.row_number().over(Window.partitionBy("profile_id").orderBy("ord", "item_id")).cast("long")).filter("rn <= 10").select("profile_id", "item_id", "rn")


@query(
    "t07_balanced_targets",
    """SELECT profile_id, item_id FROM (SELECT profile_id, item_id, row_number() OVER (PARTITION BY profile_id ORDER BY item_id) AS rn FROM (SELECT DISTINCT profile_id, item_id FROM review_queue_items WHERE profile_id IS NOT NULL)) ORDER BY rn, profile_id, item_id LIMIT 200""",
)
def _(spark, d):
    """Turns over the profiles until the limit of the report is reached."""
    r = table(spark, d, "review_queue_items").filter("profile_id is not null").select("profile_id", "item_id").distinct()
    return r.withColumn("rn", F.row_number().over(Window.partitionBy("profile_id").orderBy("item_id"))).orderBy("rn", "profile_id", "item_id").limit(200).select("profile_id", "item_id")


@query("t06_one_queue", """SELECT ord, kind, id FROM (SELECT 1 AS ord, 'readiness' AS kind, profile_id AS id FROM profile_names WHERE confidence IS NULL UNION SELECT 2, 'link', item_id FROM review_queue_items WHERE item_type = 'link' AND priority = 'high' UNION SELECT 3, 'claim', item_id FROM review_queue_items WHERE item_type = 'claim' AND risk = 'high' UNION SELECT 4, 'signal', item_id FROM review_queue_items WHERE subject_kind = 'reviewable_document_signal' AND priority = 'high' UNION SELECT 5, 'warning', document_id FROM source_documents WHERE deleted_at IS NOT NULL)""")
def _(spark, d):
    """One queue of what waits: profiles that aren't ready, links, claims, signals, warnings, in this order."""
    one = lambda o, kind, df, key: df.select(F.lit(o).alias("ord"), F.lit(kind).alias("kind"), F.col(key).alias("id"))
    q = table(spark, d, "review_queue_items")
    out = one(1, "readiness", table(spark, d, "profile_names").filter("confidence is null"), "profile_id").unionByName(one(2, "link", q.filter("item_type = 'link' AND priority = 'high'"), "item_id"))
    out = out.unionByName(one(3, "claim", q.filter("item_type = 'claim' AND risk = 'high'"), "item_id")).unionByName(one(4, "signal", q.filter("subject_kind = 'reviewable_document_signal' AND priority = 'high'"), "item_id"))
    return out.unionByName(one(5, "warning", table(spark, d, "source_documents").filter("deleted_at is not null"), "document_id")).distinct()


@query("f20_name_attempts", """SELECT DISTINCT attempt FROM (SELECT unnest([trim(g) || ' ' || trim(f), trim(f) || ' ' || trim(g), substr(trim(g), 1, 1) || '. ' || trim(f)]) AS attempt FROM (SELECT given_name AS g, family_name AS f FROM person_queries WHERE trim(coalesce(given_name, '')) <> '' AND trim(coalesce(family_name, '')) <> ''))""")
def _(spark, d):
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    g, f = F.trim("given_name"), F.trim("family_name")
    tries = F.array(F.concat(g, F.lit(" "), f), F.concat(f, F.lit(" "), g), F.concat(F.substring(g, 1, 1), F.lit(". "), f))
    return table(spark, d, "person_queries").filter(full("given_name") & full("family_name")).select(F.explode(tries).alias("attempt")).distinct()


@query("w05_segment_index", r"""SELECT doc_id, count(*) AS segments, CAST(max(pos) AS BIGINT) AS last_pos FROM (SELECT doc_id, i - 1 AS pos, p[i] AS s FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?…]) +', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL))) WHERE regexp_matches(s, '1[89][0-9][0-9]') GROUP BY 1""")
def _(spark, d):
    from ..operators.documents import sentences

    s = sentences(table(spark, d, "documents").filter("text is not null"), "doc_id", "text").filter(F.col("sentence").rlike("1[89][0-9][0-9]"))
    return s.groupBy("doc_id").agg(_n().alias("segments"), F.max("pos").cast("long").alias("last_pos"))


@query("sc14_top_hits", f"""SELECT hit_id, result_id, score FROM (SELECT h.hit_id, h.result_id, len(list_intersect(string_split({_LABEL.format('h.title')}, ' '), string_split({_LABEL.format('r.query')}, ' '))) AS score, row_number() OVER (PARTITION BY h.result_id ORDER BY len(list_intersect(string_split({_LABEL.format('h.title')}, ' '), string_split({_LABEL.format('r.query')}, ' '))) DESC, h.hit_id) AS rn
 FROM (SELECT DISTINCT hit_id, result_id, title FROM search_hits WHERE title IS NOT NULL) h JOIN (SELECT id, min(query) AS query FROM source_results WHERE query IS NOT NULL GROUP BY 1) r ON r.id = h.result_id) WHERE rn <= 3""")
def _(spark, d):
    h = table(spark, d, "search_hits").filter("title is not null").select("hit_id", "result_id", "title").distinct()
    r = table(spark, d, "source_results").filter("query is not null").groupBy(F.col("id").alias("result_id")).agg(F.min("query").alias("query"))
    toks = lambda c: F.split(T.label_form(c), " ")
    j = h.join(r, "result_id").withColumn("score", F.size(F.array_intersect(toks("title"), toks("query"))))
    w = Window.partitionBy("result_id").orderBy(F.desc("score"), "hit_id")
    return j.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("hit_id", "result_id", F.col("score").cast("long").alias("score"))


_DIGEST = "SELECT source_id, CAST(sum(CAST(('0x' || substr(md5(document_id || ':' || coalesce(content_hash, '')), 1, 12))::BIGINT AS HUGEINT)) AS VARCHAR) || '-' || CAST(count(*) AS VARCHAR) AS s, max(registered_at) AS last_at FROM (SELECT source_id, document_id, content_hash, max(registered_at) AS registered_at FROM source_documents WHERE registered_at < TIMESTAMP '{}' GROUP BY 1, 2, 3) GROUP BY 1"


@query("st03_reusable_steps", f"SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.s = b.s, false) AND EXISTS (SELECT 1 FROM detail_pages p WHERE p.source_id = b.source_id) AS reusable FROM ({_DIGEST.format('2024-06-01')}) a FULL JOIN ({_DIGEST.format('2024-09-01')}) b ON a.source_id = b.source_id WHERE coalesce(a.source_id, b.source_id) IS NOT NULL")
def _(spark, d):
    """Steps whose digest of inputs is the same as at the last run and whose outputs (fetched pages) exist."""
    s = table(spark, d, "source_documents").filter("source_id is not null").withColumn("at", F.col("registered_at").cast("timestamp_ntz"))
    digest = lambda day, name: set_digest(s.filter(F.col("at") < F.lit(f"{day} 00:00:00").cast("timestamp_ntz")).select("source_id", "document_id", "content_hash").distinct(), ["source_id"], ["document_id", "content_hash"]).withColumnRenamed("digest", name)
    made = table(spark, d, "detail_pages").select("source_id").distinct().withColumn("made", F.lit(True))
    both = digest("2024-06-01", "a").join(digest("2024-09-01", "b"), "source_id", "full_outer").join(made, "source_id", "left")
    return both.select("source_id", (F.coalesce(F.col("a") == F.col("b"), F.lit(False)) & F.coalesce("made", F.lit(False))).alias("reusable"))


@query("o46_tiles", "SELECT doc_id, CAST(count(*) AS BIGINT) AS tiles FROM (SELECT doc_id, unnest(range(0, CASE WHEN n_chars <= 500 THEN 1 ELSE CAST(ceil((n_chars - 500) / 450.0) AS BIGINT) + 1 END)) AS i FROM documents WHERE n_chars IS NOT NULL) GROUP BY 1")
def _(spark, d):
    n = F.when(F.col("n_chars") <= 500, F.lit(1).cast("long")).otherwise(F.ceil((F.col("n_chars") - 500) / 450.0) + 1)
    return table(spark, d, "documents").filter("n_chars is not null").select("doc_id", n.alias("tiles"))


QUERIES, SQL = query.QUERIES, query.SQL
