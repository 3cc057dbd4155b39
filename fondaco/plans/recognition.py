"""Queries on the quality and layout of recognised pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ACCENTS, word_tokens
from ..operators.documents import box_overlap
from ..operators.recognition import bound_column, ratio, token_alignment
from ..operators.relational import islands
from ..session import cut, table
from .base import Registry

query = Registry()


def _n():
    return F.count(F.lit(1))


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """page_id, language, recognised and reference text of the pages that have both."""
    o = table(spark, d, "ocr_pages").groupBy("page_id").agg(F.min(F.struct(F.array_join(F.transform("regions", lambda r: r["text"]), " ").alias("t"), "language")).alias("m"))
    r = table(spark, d, "page_references").filter("text <> ''").groupBy("page_id").agg(F.min(F.replace("text", F.lit("\n"), F.lit(" "))).alias("reference"))
    return o.select("page_id", F.col("m.t").alias("recognised"), F.col("m.language").alias("language")).join(r, "page_id")


_TEXTS = """(SELECT o.page_id, o.m.t AS recognised, o.m.language AS language, r.reference FROM (SELECT page_id, min({'t': array_to_string(list_transform(regions, lambda x: x.text), ' '), 'language': language}) AS m FROM ocr_pages GROUP BY 1) o
 JOIN (SELECT page_id, min(replace(text, chr(10), ' ')) AS reference FROM page_references WHERE text <> '' GROUP BY 1) r USING (page_id))"""


def folded(c: str):
    """Text as its characters are compared: lower case, no accents, any other sign beyond ASCII as one sign."""
    return F.regexp_replace(F.translate(F.lower(c), *ACCENTS), "[^ -~]", "?")


_FOLDED = f"(SELECT page_id, language, regexp_replace(translate(lower(reference), '{ACCENTS[0]}', '{ACCENTS[1]}'), '[^ -~]', '?', 'g') AS a, regexp_replace(translate(lower(recognised), '{ACCENTS[0]}', '{ACCENTS[1]}'), '[^ -~]', '?', 'g') AS b FROM {_TEXTS})"


@query("o01_character_errors", f"SELECT page_id, levenshtein(a, b) AS edits, length(a) AS chars FROM {_FOLDED}")
def character_errors(spark, d):
    return page_texts(spark, d).select("page_id", F.levenshtein(folded("reference"), folded("recognised")).cast("long").alias("edits"), F.length(folded("reference")).cast("long").alias("chars"))


@query("o07_micro_average", f"SELECT language, count(*) AS pages, CAST(sum(levenshtein(a, b)) AS BIGINT) AS edits, CAST(sum(length(a)) AS BIGINT) AS chars, round(sum(levenshtein(a, b)) * 1.0::DOUBLE / sum(length(a)), 9) AS cer FROM {_FOLDED} GROUP BY 1")
def _(spark, d):
    """Rates from summed counts: sums first, the division last."""
    t = page_texts(spark, d).withColumn("e", F.levenshtein(folded("reference"), folded("recognised"))).withColumn("c", F.length(folded("reference")))
    return t.groupBy("language").agg(_n().alias("pages"), F.sum("e").alias("edits"), F.sum("c").alias("chars"), F.round(F.sum("e") / F.sum("c"), 9).alias("cer"))


@query("o08_token_alignment")
def token_alignments(spark, d):
    t = page_texts(spark, d)
    return token_alignment(t.select("page_id", word_tokens("reference").alias("ref"), word_tokens("recognised").alias("out")), "page_id", "ref", "out")


_BAGS = f"""(SELECT page_id, coalesce(a.t, b.t) AS t, coalesce(a.n, 0) AS nr, coalesce(b.n, 0) AS no FROM (SELECT page_id, t, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(reference), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {_TEXTS}) GROUP BY 1, 2) a
 FULL JOIN (SELECT page_id, t, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(recognised), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {_TEXTS}) GROUP BY 1, 2) b USING (page_id, t))"""


@query("o09_token_ratios", f"""SELECT page_id, round(sum(least(nr, no)) * 1.0::DOUBLE / nullif(sum(nr), 0), 6) AS coverage, round(greatest(0, sum(no) - sum(least(nr, no))) * 1.0::DOUBLE / nullif(sum(no), 0), 6) AS invention, round(sum(least(nr, no)) * 1.0::DOUBLE / nullif(sum(no), 0), 6) AS accuracy, round(least(1.0::DOUBLE, sum(no) * 1.0::DOUBLE / nullif(sum(nr), 0)), 6) AS completeness FROM {_BAGS} GROUP BY 1""")
def token_ratios(spark, d):
    """Four ratios from the multiset intersection of tokens: the reference's share that is there, the output's that is right and that is invented, and the output's length."""
    t = page_texts(spark, d)
    bag = lambda c, n: t.select("page_id", F.explode(word_tokens(c)).alias("t")).groupBy("page_id", "t").agg(_n().alias(n))
    b = bag("reference", "nr").join(bag("recognised", "no"), ["page_id", "t"], "full_outer").fillna(0, ["nr", "no"])
    s = b.groupBy("page_id").agg(F.sum(F.least("nr", "no")).alias("common"), F.sum("nr").alias("ref"), F.sum("no").alias("out"))
    return s.select("page_id", F.round(ratio(F.col("common"), F.col("ref")), 6).alias("coverage"), F.round(ratio(F.col("out") - F.col("common"), F.col("out")), 6).alias("invention"), F.round(ratio(F.col("common"), F.col("out")), 6).alias("accuracy"), F.round(ratio(F.col("out"), F.col("ref")), 6).alias("completeness"))


_CONF = "(SELECT engine, round(unnest(list_transform(regions, lambda x: x.confidence)), 4) AS c FROM ocr_pages)"


@query("o13_confidence_statistics", f"""SELECT engine, count(*) AS regions, count(c) AS scored, round(avg(c), 6) AS mean, quantile_disc(c, 0.5) AS median, quantile_disc(c, 0.1) AS p10, min(c) AS least, max(c) AS most, max(c) > 1 AND min(c) <= 1 AS mixed_scale FROM {_CONF} GROUP BY 1""")
def _(spark, d):
    """Nearest-rank statistics from a histogram of scores in ten-thousandths, so a group is never gathered."""
    r = table(spark, d, "ocr_pages").select("engine", F.explode(F.transform("regions", lambda x: F.round(x["confidence"], 4))).alias("c"))
    h = r.groupBy("engine", "c").agg(_n().alias("n"))
    scored = h.filter("c is not null")
    w = Window.partitionBy("engine").orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(Window.partitionBy("engine"))
    ranked = scored.select("engine", "c", "n", F.sum("n").over(w).alias("upto"), total.alias("all"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("all") * q), F.lit(1)), F.col("c")))
    stats = ranked.groupBy("engine").agg(F.sum("n").alias("scored"), F.round(F.sum(F.col("c") * F.col("n")) / F.sum("n"), 6).alias("mean"), at(0.5).alias("median"), at(0.1).alias("p10"), F.min("c").alias("least"), F.max("c").alias("most"))
    regions = h.groupBy("engine").agg(F.sum("n").alias("regions"))
    out = regions.join(stats, "engine", "left")
    return out.select("engine", "regions", F.coalesce("scored", F.lit(0)).alias("scored"), "mean", "median", "p10", "least", "most", ((F.col("most") > 1) & (F.col("least") <= 1)).alias("mixed_scale"))


@query("o14_page_risk", f"""SELECT page_id, greatest(1 - coverage, invention) AS risk FROM ({query.SQL['o09_token_ratios']})""")
def page_risk(spark, d):
    # greatest() skips nulls, but a missing part means no score
    return token_ratios(spark, d).select("page_id", F.when(F.col("coverage").isNotNull() & F.col("invention").isNotNull(), F.greatest(1 - F.col("coverage"), "invention")).alias("risk"))


def _cdf_sql(k: str, n: str, p: str) -> str:
    """P(X <= k) of a binomial, summed term by term."""
    k, n = f"CAST({k} AS BIGINT)", f"CAST({n} AS BIGINT)"
    return f"list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))"


_WRONG = f"(SELECT language, count_if(levenshtein(a, b) > 0.1 * length(a)) AS bad, count(*) AS pages FROM {_FOLDED} GROUP BY 1)"


@query(
    "o17_error_bounds",
    f"""WITH RECURSIVE s AS (SELECT * FROM {_WRONG}), b AS (SELECT bad AS k, pages AS n, bad * 1.0::DOUBLE / pages AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM (SELECT DISTINCT bad, pages FROM s WHERE bad < pages)
    UNION ALL SELECT k, n, CASE WHEN {_cdf_sql('k', 'n', '((lo + hi) / 2)')} > 0.05 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_cdf_sql('k', 'n', '((lo + hi) / 2)')} > 0.05 THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM b WHERE step < 45)
    SELECT language, bad, pages, coalesce(round((SELECT hi FROM b WHERE k = bad AND n = pages AND step = 45), 6), 1.0) AS upper_bound FROM s""",
)
def error_bounds(spark, d):
    """Pages of each language with a tenth of the characters wrong, and the exact upper bound of their share."""
    t = page_texts(spark, d).withColumn("bad", F.levenshtein(folded("reference"), folded("recognised")) > 0.1 * F.length(folded("reference")))
    s = t.groupBy("language").agg(F.count_if("bad").alias("bad"), _n().alias("pages"))
    return s.select("language", "bad", "pages", F.round(bound_column("bad", "pages"), 6).alias("upper_bound"))


#: A page breaches above this risk; share of breaching pages that the exact bound may reach; confidence of the bound is 1 - ALPHA.
BREACH, LIMIT, ALPHA = 0.3, 0.6, 0.05
_RISK = f"(SELECT l.language, round(r.risk, 4) AS risk, r.page_id FROM ({query.SQL['o14_page_risk']}) r JOIN {_TEXTS} l USING (page_id) WHERE r.risk IS NOT NULL)"


def scored_pages(spark, d):
    """(page_id, language, risk) with risks of four digits."""
    lang = page_texts(spark, d).select("page_id", "language")
    return page_risk(spark, d).filter("risk is not null").join(lang, "page_id").select("page_id", "language", F.round("risk", 4).alias("risk"))


@query(
    "o15_threshold",
    f"""SELECT max(cutoff) AS cutoff FROM (SELECT c.cutoff, bool_and({_cdf_sql('s.bad', 's.n', str(LIMIT))} <= {ALPHA} AND s.n > s.bad) AS fine FROM (SELECT DISTINCT risk AS cutoff FROM {_RISK}) c, LATERAL (SELECT g.language, coalesce(count(x.page_id), 0) AS n, coalesce(count_if(x.risk > {BREACH}), 0) AS bad FROM (SELECT DISTINCT language FROM {_RISK}) g LEFT JOIN {_RISK} x ON x.language = g.language AND x.risk <= c.cutoff GROUP BY 1) s GROUP BY 1) WHERE fine""",
)
def _(spark, d):
    """The largest cutoff at which every language's exact upper bound of breaching pages is within the limit.

    Scores have four digits, so the grid of cutoffs and languages is bounded however many pages there are.
    """
    s = scored_pages(spark, d).groupBy("language", "risk").agg(_n().alias("n"), F.count_if(F.col("risk") > BREACH).alias("bad"))
    grid = s.select("risk").distinct().join(F.broadcast(s.select("language").distinct()))  # scores times languages
    w = Window.partitionBy("language").orderBy("risk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = grid.join(s, ["language", "risk"], "left").select("language", "risk", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"), F.coalesce(F.sum("bad").over(w), F.lit(0)).alias("bad"))
    fine = upto.withColumn("fine", bound_column("bad", "n", ALPHA) <= LIMIT).groupBy("risk").agg(F.bool_and("fine").alias("fine"))
    return fine.filter("fine").agg(F.max("risk").alias("cutoff"))


_HELD = f"(SELECT *, ('0x' || substr(md5(page_id), 1, 1))::INT >= 8 AS held FROM {_RISK})"


@query(
    "o16_holdout_audit",
    f"""WITH x AS (SELECT language, count_if(risk <= 0.5) AS accepted, count_if(risk <= 0.5 AND risk > {BREACH}) AS bad FROM {_HELD} WHERE held GROUP BY 1), y AS (SELECT * FROM x UNION ALL SELECT 'all', CAST(sum(accepted) AS BIGINT), CAST(sum(bad) AS BIGINT) FROM x)
    SELECT language, accepted, bad, accepted > bad AND coalesce({_cdf_sql('bad', 'accepted', str(LIMIT))} <= {ALPHA} / (SELECT count(*) FROM y), false) AS passed FROM y""",
)
def _(spark, d):
    """Pages held out by hash, those within a cutoff: each language and all together against the exact bound, Bonferroni's correction for their number."""
    held = scored_pages(spark, d).filter(F.conv(F.substring(F.md5(F.col("page_id").cast("binary")), 1, 1), 16, 10).cast("int") >= 8)
    x = held.groupBy("language").agg(F.count_if(F.col("risk") <= 0.5).alias("accepted"), F.count_if((F.col("risk") <= 0.5) & (F.col("risk") > BREACH)).alias("bad"))
    y = cut(x.unionByName(x.agg(F.sum("accepted").alias("accepted"), F.sum("bad").alias("bad")).select(F.lit("all").alias("language"), "accepted", "bad")))
    m = max(1, y.count())  # languages and one
    return y.select("language", "accepted", "bad", ((F.col("accepted") > F.col("bad")) & (bound_column("bad", "accepted", ALPHA / m) <= LIMIT)).alias("passed"))


@query("o20_provisional_cutoff", f"SELECT max(risk) AS cutoff, count(*) AS cases FROM (SELECT risk, min(CASE WHEN risk > {BREACH} THEN risk END) OVER () AS first_bad FROM (SELECT risk FROM {_RISK} ORDER BY md5(page_id), page_id LIMIT 10)) WHERE first_bad IS NULL OR risk < first_bad")
def _(spark, d):
    """Of ten pages drawn by hash, the largest score below every breaching one (the sample is the operator's own rule)."""
    s = scored_pages(spark, d).orderBy(F.md5(F.col("page_id").cast("binary")), "page_id").limit(10)
    first = s.agg(F.min(F.when(F.col("risk") > BREACH, F.col("risk"))).alias("first_bad"))  # one row
    return s.join(F.broadcast(first)).filter("first_bad is null OR risk < first_bad").agg(F.max("risk").alias("cutoff"), _n().alias("cases"))


@query("o21_dispositions", f"SELECT o.page_id, CASE WHEN r.risk IS NULL THEN 'review' WHEN o.language NOT IN ('ita', 'deu') THEN 'review' WHEN r.risk <= 0.25 THEN 'accept' ELSE 'review' END AS disposition, CASE WHEN r.risk IS NULL THEN 'no_score' WHEN o.language NOT IN ('ita', 'deu') THEN 'out_of_scope' WHEN r.risk <= 0.25 THEN 'within_cutoff' ELSE 'above_cutoff' END AS reason FROM (SELECT page_id, min(language) AS language FROM ocr_pages GROUP BY 1) o LEFT JOIN {_RISK} r USING (page_id)")
def _(spark, d):
    o = table(spark, d, "ocr_pages").groupBy("page_id").agg(F.min("language").alias("scope"))
    r = F.col("risk")
    reason = F.when(r.isNull(), "no_score").when(~F.col("scope").isin("ita", "deu"), "out_of_scope").when(r <= 0.25, "within_cutoff").otherwise("above_cutoff")
    return o.join(scored_pages(spark, d), "page_id", "left").withColumn("reason", reason).select("page_id", F.when(F.col("reason") == "within_cutoff", "accept").otherwise("review").alias("disposition"), "reason")


@query("o12_page_features", f"""SELECT page_id, round(coverage, 6) AS coverage, round(1 - levenshtein(a, b) * 1.0::DOUBLE / greatest(length(a), length(b)), 6) AS agreement, confidence FROM ({query.SQL['o09_token_ratios']}) JOIN {_FOLDED} USING (page_id) JOIN (SELECT page_id, round(list_avg(list_transform(min(regions), lambda x: x.confidence)), 6) AS confidence FROM ocr_pages GROUP BY 1) USING (page_id)""")
def _(spark, d):
    """Agreement of the characters, coverage of the tokens and mean confidence of each page."""
    t = page_texts(spark, d)
    a, b = folded("reference"), folded("recognised")
    agree = t.select("page_id", F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)), 6).alias("agreement"))
    conf = F.filter(F.transform("regions", lambda x: x["confidence"]), lambda c: c.isNotNull())
    c = table(spark, d, "ocr_pages").groupBy("page_id").agg(F.min("regions").alias("regions")).select("page_id", F.round(F.when(F.size(conf) > 0, F.aggregate(conf, F.lit(0.0), lambda x, y: x + y) / F.size(conf)), 6).alias("confidence"))
    return token_ratios(spark, d).select("page_id", F.round("coverage", 6).alias("coverage")).join(agree, "page_id").join(c, "page_id")


_REGIONS = "(SELECT page_id, i - 1 AS line_no, regions[i].text AS text, regions[i].confidence AS confidence, regions[i].geometry.bbox AS box FROM (SELECT page_id, regions, unnest(range(1, len(regions) + 1)) AS i FROM (SELECT page_id, min(regions) AS regions FROM ocr_pages GROUP BY 1)))"


def regions(spark: SparkSession, d: str) -> DataFrame:
    """One row per visual line of each page."""
    o = table(spark, d, "ocr_pages").groupBy("page_id").agg(F.min("regions").alias("regions"))
    return o.select("page_id", F.posexplode("regions").alias("line_no", "r")).select("page_id", F.col("line_no").cast("long").alias("line_no"), "r.text", "r.confidence", F.col("r.geometry.bbox").alias("box"))


#: By how much the second reading of the overlap query lies lower, as the tables hold one reading of each page.
SHIFT = 12.0
_PAIRS = f"""(SELECT a.page_id, a.line_no AS first_no, b.line_no AS second_no, a.text IS NOT DISTINCT FROM b.text AS same FROM {_REGIONS} a JOIN {_REGIONS} b ON a.page_id = b.page_id
 WHERE least(a.box[3], b.box[3]) > greatest(a.box[1], b.box[1]) AND least(a.box[4], b.box[4] + {SHIFT}) > greatest(a.box[2], b.box[2] + {SHIFT}))"""


@query(
    "j31_region_overlap",
    f"""WITH p AS {_PAIRS}, f AS (SELECT page_id, first_no, count(*) AS k FROM p GROUP BY 1, 2), g AS (SELECT page_id, second_no, count(*) AS k FROM p GROUP BY 1, 2)
    SELECT p.page_id, CASE WHEN f.k = 1 AND g.k = 1 AND same THEN 'agree' WHEN f.k = 1 AND g.k = 1 THEN 'disagree' ELSE 'ambiguous' END AS state, count(*) AS pairs FROM p JOIN f USING (page_id, first_no) JOIN g USING (page_id, second_no) GROUP BY 1, 2""",
)
def _(spark, d):
    """Regions of two readings of a page (the second one derived) that overlap: alone with each other, with the same text or another, or in larger groups."""
    # boxes meet in bands of their height, so a page's regions are never all paired
    band = 100.0
    r = regions(spark, d).select("page_id", "line_no", "text", "box").filter("box is not null")
    low = r.withColumn("box", F.transform("box", lambda v, i: F.when(i % 2 == 1, v + SHIFT).otherwise(v)))
    banded = lambda df: df.withColumn("band", F.explode(F.sequence(F.floor(F.col("box")[1] / band), F.floor(F.col("box")[3] / band))))
    a = banded(r).select("page_id", "band", F.col("line_no").alias("first_no"), F.col("box").alias("x"), F.col("text").alias("ta"))
    b = banded(low).select("page_id", "band", F.col("line_no").alias("second_no"), F.col("box").alias("y"), F.col("text").alias("tb"))
    met = a.join(b, ["page_id", "band"]).filter(box_overlap(F.col("x"), F.col("y")) > 0)
    p = met.groupBy("page_id", "first_no", "second_no").agg(F.bool_and(F.col("ta").eqNullSafe(F.col("tb"))).alias("same"))
    alone = lambda c: F.count(F.lit(1)).over(Window.partitionBy("page_id", c)) == 1
    one = alone("first_no") & alone("second_no")
    p = p.withColumn("one", one)
    return p.groupBy("page_id", F.when(F.col("one") & F.col("same"), "agree").when(F.col("one"), "disagree").otherwise("ambiguous").alias("state")).agg(_n().alias("pairs"))


@query("o38_page_lines", f"""SELECT page_id, count(*) AS lines, round(avg(confidence), 6) AS confidence, min(box[1]) AS x0, min(box[2]) AS y0, max(box[3]) AS x1, max(box[4]) AS y1 FROM {_REGIONS} GROUP BY 1""")
def _(spark, d):
    b = F.col("box")
    return regions(spark, d).groupBy("page_id").agg(_n().alias("lines"), F.round(F.avg("confidence"), 6).alias("confidence"), F.min(b[0]).alias("x0"), F.min(b[1]).alias("y0"), F.max(b[2]).alias("x1"), F.max(b[3]).alias("y1"))


@query(
    "w06_blocks",
    f"""SELECT page_id, island, count(*) AS lines, min(line_no) AS first_line, max(box[4]) AS bottom FROM (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM
    (SELECT *, box[2] - lag(box[4]) OVER (PARTITION BY page_id ORDER BY line_no) AS gap FROM {_REGIONS})) GROUP BY ALL""",
)
def _(spark, d):
    r = regions(spark, d)
    gap = F.col("box")[1] - F.lag(F.col("box")[3]).over(Window.partitionBy("page_id").orderBy("line_no"))
    r = r.withColumn("gap", gap)
    return islands(r, ["page_id"], "line_no", F.col("gap").isNull() | (F.col("gap") > 12)).groupBy("page_id", "island").agg(_n().alias("lines"), F.min("line_no").alias("first_line"), F.max(F.col("box")[3]).alias("bottom"))


@query("t09_reading_order", f"SELECT page_id, line_no, row_number() OVER (PARTITION BY page_id ORDER BY box[2] NULLS LAST, box[1] NULLS LAST, line_no) - 1 AS reading_pos FROM {_REGIONS}")
def _(spark, d):
    w = Window.partitionBy("page_id").orderBy(F.asc_nulls_last(F.col("box")[1]), F.asc_nulls_last(F.col("box")[0]), "line_no")
    return regions(spark, d).select("page_id", "line_no", (F.row_number().over(w) - 1).cast("long").alias("reading_pos"))


@query("sk14_page_text", "SELECT page_id, min(array_to_string(list_transform(regions, lambda x: x.text), chr(10))) AS text FROM ocr_pages GROUP BY 1")
def _(spark, d):
    return table(spark, d, "ocr_pages").groupBy("page_id").agg(F.min(F.array_join(F.transform("regions", lambda r: r["text"]), "\n")).alias("text"))


@query("o24_layout_issues", f"""SELECT page_id, code, count(*) AS n FROM (SELECT page_id, CASE WHEN box IS NULL OR len(box) <> 4 THEN 'no_box' WHEN box[3] <= box[1] OR box[4] <= box[2] THEN 'inverted_box' WHEN trim(coalesce(text, '')) = '' THEN 'no_text' END AS code FROM {_REGIONS}) WHERE code IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    """What is wrong with a page's regions, by code."""
    b = F.col("box")
    code = F.when(b.isNull() | (F.size(b) != 4), "no_box").when((b[2] <= b[0]) | (b[3] <= b[1]), "inverted_box").when(F.trim(F.coalesce("text", F.lit(""))) == "", "no_text")
    return regions(spark, d).select("page_id", code.alias("code")).filter("code is not null").groupBy("page_id", "code").agg(_n().alias("n"))


@query("o39_line_signals", f"""SELECT page_id, line_no, regexp_matches(text, '^\\W*[0-9]{{1,4}}\\W*$') AS numeric, upper(text) = text AND lower(text) <> text AS capitals, length(text) < 20 AS short, box[2] < 60 AS at_top FROM {_REGIONS} WHERE text IS NOT NULL AND box IS NOT NULL""")
def _(spark, d):
    """Signals of each line's shape and place."""
    r = regions(spark, d).filter("text is not null AND box is not null")
    return r.select("page_id", "line_no", F.col("text").rlike(r"^\W*[0-9]{1,4}\W*$").alias("numeric"), ((F.upper("text") == F.col("text")) & (F.lower("text") != F.col("text"))).alias("capitals"), (F.length("text") < 20).alias("short"), (F.col("box")[1] < 60).alias("at_top"))


@query("g16_page_blocks", f"""SELECT page_id, CASE WHEN regexp_matches(text, '^[^:]{{2,30}}: \\S') THEN 'key_value' WHEN upper(text) = text AND lower(text) <> text THEN 'heading' WHEN regexp_matches(text, '[.]{{3,}} *[0-9]+$') THEN 'list_entry' WHEN trim(coalesce(text, '')) = '' THEN 'unknown' ELSE 'paragraph' END AS kind, count(*) AS lines FROM {_REGIONS} GROUP BY 1, 2""")
def _(spark, d):
    """Lines of pages by what they are in the page's structure."""
    t = F.col("text")
    kind = F.when(t.rlike(r"^[^:]{2,30}: \S"), "key_value").when((F.upper(t) == t) & (F.lower(t) != t), "heading").when(t.rlike(r"[.]{3,} *[0-9]+$"), "list_entry").when(F.trim(F.coalesce(t, F.lit(""))) == "", "unknown").otherwise("paragraph")
    return regions(spark, d).groupBy("page_id", kind.alias("kind")).agg(_n().alias("lines"))


_LINES = "(SELECT page_id, i - 1 AS line_no, s[i] AS line FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT page_id, string_split(min(text), chr(10)) AS s FROM page_references WHERE text <> '' GROUP BY 1)))"
_KEYED = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query("o34_line_match_rates", f"SELECT e.engine, count(*) AS lines, round(count_if(r.text = l.line) * 1.0::DOUBLE / count(*), 6) AS exact, round(count_if({_KEYED.format('r.text')} = {_KEYED.format('l.line')}) * 1.0::DOUBLE / count(*), 6) AS normalised FROM {_REGIONS} r JOIN {_LINES} l USING (page_id, line_no) JOIN (SELECT page_id, min(engine) AS engine FROM ocr_pages GROUP BY 1) e USING (page_id) WHERE r.text IS NOT NULL GROUP BY 1")
def _(spark, d):
    """Lines of each engine that are the reference's line at their place, as they stand and without case and punctuation."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    ref = table(spark, d, "page_references").filter("text <> ''").groupBy("page_id").agg(F.min("text").alias("t"))
    ref = ref.select("page_id", F.posexplode(F.split("t", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))
    e = table(spark, d, "ocr_pages").groupBy("page_id").agg(F.min("engine").alias("engine"))
    j = regions(spark, d).filter("text is not null").join(ref, ["page_id", "line_no"]).join(e, "page_id")
    share = lambda c: F.round(F.count_if(c) / _n(), 6)
    return j.groupBy("engine").agg(_n().alias("lines"), share(F.col("text") == F.col("line")).alias("exact"), share(key("text") == key("line")).alias("normalised"))


@query("o22_consistency_issues", f"SELECT page_id, CASE WHEN r.n IS NULL THEN 'no_reference' WHEN r.n <> o.n THEN 'line_count' ELSE 'none' END AS code FROM (SELECT page_id, max(len(regions)) AS n FROM ocr_pages GROUP BY 1) o LEFT JOIN (SELECT page_id, count(*) AS n FROM {_LINES} GROUP BY 1) r USING (page_id)")
def _(spark, d):
    """Whether a page's regions and its reference go together."""
    o = table(spark, d, "ocr_pages").groupBy("page_id").agg(F.max(F.size("regions")).alias("n"))
    r = table(spark, d, "page_references").filter("text <> ''").groupBy("page_id").agg(F.size(F.split(F.min("text"), "\n")).alias("k"))
    return o.join(r, "page_id", "left").select("page_id", F.when(F.col("k").isNull(), "no_reference").when(F.col("k") != F.col("n"), "line_count").otherwise("none").alias("code"))


QUERIES, SQL = query.QUERIES, query.SQL
