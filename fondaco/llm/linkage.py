"""Linking variant spellings: n-gram TF-IDF vectors, sparse cosine join, average-linkage clustering.

1. Every record is read (:mod:`.names`) and reduced to a signature; records with equal signatures are one node, so copies of
   a name never meet as pairs before the end.
2. Distinct (initial, surname) forms become TF-IDF vectors of character n-grams. The join is exact: n-grams are in the
   global order of their frequency, rare first, and a form is posted only under the prefix whose rest can't reach the
   threshold any more (its norm is below it), so two forms as similar as the threshold share a posted n-gram.
   The initial is part of the key. The top n is unlimited by default, as every partner above the threshold counts.
3. Nodes of similar forms meet where their dates allow it: on an equal year or day, or when one has no year. Given
   names and dates are then checked exactly; contradictions end a pair.
4. Average linkage by reciprocal nearest neighbours: in each round all pairs of clusters that are each other's best merge
   at once (which gives the same clustering as merging one by one), and edge sums are added up. Clusters of
   contradicting dates or given names never merge. Nothing is gathered in one task or on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut, forget, shuffled, spread
from .names import parse_date, parse_name
from .places import place_forms, swap_distance

#: Cosine that two forms must reach; mean similarity that two clusters must reach.
COSINE, LINKAGE = 0.45, 0.5
_DATE = re.compile(r"\(?\b[\w.,/-]*\s*[^\W\d]*\.?\s*1[89]\d\d[^,)]*\)?")
#: Records under a surname from which on it counts as usual.
USUAL = 4
#: Share of the other spelling's records under which a spelling is rare beside it.
RARE = 0.1


def read_records(rows: DataFrame) -> DataFrame:
    """One row per key from (key, name, birth, death, place): initial, surname, given, birth, death, place.

    A key may come with several names (forms of one profile) and more than once: the most frequent surname and the most
    frequent whole given name stand for it, ties to the smaller string. Keys without a readable name get no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, name, birth, death, place in zip(pdf["key"], pdf["name"], pdf["birth"], pdf["death"], pdf["place"]):
                r = parse_name(name) if name and name.strip() else None
                if r is None:
                    continue
                b, d = parse_date(birth), parse_date(death)
                where = place or ""
                if not where and birth:
                    where = _DATE.sub(" ", birth).strip(" ,()")
                forms = place_forms(where)[0] if where and any(c.isalpha() for c in where) else []
                out.append((key, r[1], r[2], r[3], b, d, forms[0][1] if forms else ""))
            yield pd.DataFrame(out, columns=["key", "initial", "surname", "given", "birth", "death", "place"])

    text = "key string, initial string, surname string, given string, birth string, death string, place string"
    read = cut(spread(rows.select("key", "name", "birth", "death", "place").filter(F.col("key").isNotNull()).distinct(), "key").mapInPandas(run, text))
    n = F.count(F.lit(1))
    names = read.groupBy("key", "initial", "surname").agg(n.alias("n")).groupBy("key").agg(F.min(F.struct(-F.col("n"), "initial", "surname")).alias("s"))
    whole = F.when(F.col("given") == "", 2).when(F.col("given").rlike("[*~]"), 1).otherwise(0)
    given = read.groupBy("key", "given").agg(n.alias("n")).groupBy("key").agg(F.min(F.struct(whole, -F.col("n"), "given")).alias("g"))
    rest = read.groupBy("key").agg(F.max("birth").alias("birth"), F.max("death").alias("death"), F.max("place").alias("place"))
    return names.join(given, "key").join(rest, "key").select("key", "s.initial", "s.surname", "g.given", "birth", "death", "place")


def _grams(c: str) -> Column:
    """Distinct bigrams and trigrams of a padded word."""
    w = F.concat(F.lit("^"), F.col(c), F.lit("$"))
    part = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
    return F.array_distinct(F.concat(part(2), part(3)))


def gram_vectors(forms: DataFrame) -> DataFrame:
    """(form, g, w, rest) of forms (form, word): unit TF-IDF weights of the word's n-grams; rest is the squared weight of a gram and all
    more frequent ones, by which :func:`similar_forms` cuts the postings."""
    grams = forms.select("form", F.explode(_grams("word")).alias("g"))
    total = forms.agg(F.count(F.lit(1)).alias("total"))
    df = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    # idf is smoothed, so that a gram made by a slip doesn't outweigh all others
    w = grams.join(shuffled(df), "g").join(F.broadcast(total)).select("form", "g", "df", F.log(1 + F.col("total") / (F.col("df") + 5)).alias("w"))
    norm = Window.partitionBy("form")  # as long as a word
    order = norm.orderBy(F.desc("df"), F.desc("g")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm)))
    return w.select("form", "g", "w", F.sum(F.col("w") * F.col("w")).over(order).alias("rest"))


def with_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) of forms with the cosine of their vectors."""
    vec = vectors.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("g", "w"))).alias("v"))  # as long as one word
    both = pairs.join(shuffled(vec.select(F.col("form").alias("a"), F.col("v").alias("va"))), "a").join(shuffled(vec.select(F.col("form").alias("b"), F.col("v").alias("vb"))), "b")
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.element_at("vb", e["key"]), F.lit(0.0)))
    return both.withColumn("cosine", dot).drop("va", "vb")


def similar_forms(vectors: DataFrame, blocks: DataFrame, threshold: float = COSINE, top_n: int | None = None) -> DataFrame:
    """(a, b, cosine), a < b, of forms of one block whose vectors reach the threshold.

    vectors: of :func:`gram_vectors`; blocks: (form, block, size), a form in any number of blocks; size is the word's length, and words
    meet only while their lengths differ by 2 at most. With ``top_n`` a pair must be among the best of either form.
    """
    posted = vectors.filter(F.col("rest") >= threshold * threshold).select("form", "g").join(shuffled(blocks), "form")
    side = lambda f, n: posted.select(F.col("form").alias(f), F.col("size").alias(n), "block", "g")
    pairs = side("a", "na").join(shuffled(side("b", "nb")), ["block", "g"]).filter("a < b AND abs(na - nb) <= 2").select("a", "b").distinct()
    out = with_cosine(pairs, vectors).filter(F.col("cosine") >= threshold)
    if top_n:
        rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("cosine"), "a", "b"))
        out = out.withColumn("ra", rank("a")).withColumn("rb", rank("b")).filter((F.col("ra") <= top_n) | (F.col("rb") <= top_n)).drop("ra", "rb")
    return out


def edit_pairs(forms: DataFrame) -> DataFrame:
    """(a, b) of distinct forms whose words are exactly one edit apart, a swap of neighbours as one; all of them and no others.

    Each kind of edit has its own key: the word without its i-th character and the place i (one put for another), the word with two
    unequal neighbours in order and their place (a swap), and the word without a character against the whole one (one left out). Unlike a
    cosine, that doesn't depend on the vocabulary, and a key's words are all results.
    forms: form (unique), block (only forms of one block meet), role, word. Forms of role 'l' meet forms of role 'r'; forms of
    role 'lr' also meet each other, once (a < b).
    """
    n = F.length("word")
    at = F.sequence(F.lit(1), n)
    char = lambda i: F.substr("word", i, F.lit(1))
    less = lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1))
    key = lambda kind, i, text, own: F.struct(F.lit(kind).alias("kind"), i.alias("at"), text.alias("text"), own.alias("own"))
    no = F.lit(0)
    put = F.transform(at, lambda i: key("put", i, less(i), char(i)))
    order = lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.least(char(i), char(i + 1)), F.greatest(char(i), char(i + 1)), F.substr("word", i + 2))
    turn = F.transform(F.filter(at, lambda i: (i < n) & (char(i) != char(i + 1))), lambda i: key("turn", i, order(i), char(i)))
    drop = F.transform(F.array_distinct(F.transform(at, less)), lambda t: key("drop", no, t, F.lit("less")))
    keys = forms.filter(n > 0).select("form", "block", "role", F.explode(F.concat(put, turn, drop, F.array(key("drop", no, F.col("word"), F.lit("whole"))))).alias("k")).select("form", "block", "role", "k.*")
    on = ["block", "kind", "at", "text"]
    left = keys.filter(F.col("role").contains("l")).select(F.col("form").alias("a"), F.col("role").alias("ra"), F.col("own").alias("oa"), *on)
    right = keys.filter(F.col("role").contains("r")).select(F.col("form").alias("b"), F.col("role").alias("rb"), F.col("own").alias("ob"), *on)
    # the same letter is the same word; two words that both lost a letter are two edits apart
    met = left.join(shuffled(right), on).filter("oa <> ob").filter("(ra = 'lr' AND rb = 'lr') OR (ra <> rb)")
    lo, hi = F.when((F.col("ra") == "lr") & (F.col("rb") == "lr"), F.least("a", "b")).otherwise(F.col("a")), F.when((F.col("ra") == "lr") & (F.col("rb") == "lr"), F.greatest("a", "b")).otherwise(F.col("b"))
    return met.select(lo.alias("a"), hi.alias("b")).filter("a <> b").distinct()


def rare(a: str, b: str) -> Column:
    """Whether the less frequent of two spellings may be a slip of the other: few records, or few beside the other's."""
    return F.least(a, b) < F.greatest(F.lit(USUAL), F.greatest(a, b) * RARE)


def usual_spelling(words: DataFrame) -> DataFrame:
    """(word, usual) of rare surnames that are one edit from a surname that stands far more often, if there is one only.

    Rare is meant beside the other spelling (:func:`rare`), so a slip that many copies repeat is led back as well.

    words: word (unique), n.
    """
    w = cut(words.select(F.xxhash64("word").alias("form"), F.lit("").alias("block"), F.lit("lr").alias("role"), "word", "n"))
    e = edit_pairs(w)
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = e.join(w.select(F.col("form").alias("a"), F.col("word"), F.col("n").alias("na")), "a").join(w.select(F.col("form").alias("b"), F.col("word").alias("usual"), F.col("n").alias("nb")), "b")
    e = e.filter(rare("na", "nb") & F.expr(f"nb >= {USUAL} AND nb >= 4 * na AND length(word) >= 5"))
    e = cut(e.select("word", "usual"))
    while True:  # a usual spelling may itself be rare beside another; counts grow fourfold along a chain, so it ends
        one = e.groupBy("word").agg(F.min("usual").alias("usual"), F.max("usual").alias("other")).filter("usual = other").select("word", "usual")
        on = one.select(F.col("word").alias("usual"), F.col("usual").alias("next"))
        if e.join(on, "usual", "left_semi").isEmpty():
            return one
        e, old = cut(e.join(on, "usual", "left").select("word", F.coalesce("next", "usual").alias("usual")).distinct()), e
        forget(old)


@F.pandas_udf(T.IntegerType())
def swaps(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between two words, a swap of neighbours as one."""
    return pd.Series([swap_distance(x, y) for x, y in zip(a, b)], dtype="int32")


def agree(a: Column, b: Column) -> Column:
    """Whether two dates may be the same: one begins the other, the unknown with all."""
    return a.startswith(b) | b.startswith(a)


def _given_factor(a: Column, b: Column) -> Column:
    """1 equal, less for cut and misread names and initials, null for a contradiction."""
    pa, pb = F.regexp_replace(a, r"\*$", ""), F.regexp_replace(b, r"\*$", "")
    unknown = a.startswith("~") | b.startswith("~")
    ua, ub = F.regexp_replace(a, "^~", ""), F.regexp_replace(b, "^~", "")
    return (
        F.when((a == "") & (b == ""), 0.7).when((a == "") | (b == ""), 0.75).when(a == b, 1.0)
        .when((a.endswith("*") & b.startswith(pa)) | (b.endswith("*") & a.startswith(pb)), 0.95)
        .when(unknown & (F.levenshtein(ua, ub) <= F.when(F.length(ua) >= 6, 2).otherwise(1)), 0.9)
    )


def node_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, sim) of nodes a < b that similar forms and their dates, given names and places allow."""
    side = lambda p: nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in ("node", "form", "given", "birth", "death", "place")], F.filter(F.array(F.when(F.col("birth") != "", F.concat(F.lit("b"), F.substring("birth", 1, 4))), F.when(F.col("death") != "", F.concat(F.lit("d"), F.col("death")))), lambda x: x.isNotNull()).alias(f"{p}_keys"))
    a, b = side("a"), side("b")
    e = edges.select(F.col("a").alias("a_form"), F.col("b").alias("b_form"), "edits", "cosine")
    le = a.join(e, "a_form")
    keyed = le.withColumn("k", F.explode("a_keys")).join(shuffled(b.withColumn("k", F.explode("b_keys"))), ["b_form", "k"]).drop("k")
    open_a = le.filter("a_birth = ''").join(b, "b_form")
    open_b = le.filter("a_birth <> ''").join(b.filter("b_birth = ''"), "b_form")
    cols = [f"{p}_{c}" for p in "ab" for c in ("node", "given", "birth", "death", "place")] + ["edits", "cosine"]
    p = keyed.select(*cols).unionByName(open_a.select(*cols)).unionByName(open_b.select(*cols))
    p = p.filter("a_node <> b_node").filter(agree(F.col("a_birth"), F.col("b_birth")) & agree(F.col("a_death"), F.col("b_death")))
    p = p.withColumn("g", _given_factor(F.col("a_given"), F.col("b_given"))).filter("g is not null")
    sure = ((F.length("a_birth") >= 4) & (F.length("b_birth") >= 4)) | ((F.length("a_death") >= 4) & (F.length("b_death") >= 4))
    where = F.when((F.col("a_place") == "") | (F.col("b_place") == ""), 0.0).when((F.col("a_place") == F.col("b_place")) | (F.levenshtein("a_place", "b_place") <= 2), 0.1).otherwise(-0.05)
    p = p.withColumn("sure", sure | (where > 0)).filter("edits <= 1 or sure")
    # the cosine of half the angle, squared: 1 for one spelling
    sim = (1 + F.col("cosine")) / 2 * F.col("g") * (F.when(sure, 1.0).otherwise(0.85) + where)
    lo, hi = F.least("a_node", "b_node"), F.greatest("a_node", "b_node")
    p = p.select(lo.alias("a"), hi.alias("b"), sim.alias("sim"), "sure", F.when(F.col("a_node") == lo, F.col("a_given")).otherwise(F.col("b_given")).alias("ga"), F.when(F.col("a_node") == lo, F.col("b_given")).otherwise(F.col("a_given")).alias("gb"))
    p = p.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("sure").alias("sure"), F.max("ga").alias("ga"), F.max("gb").alias("gb"))
    # an initial or a cut name says nothing where several given names fit it, unless a date does
    loose = lambda g: (F.col(g) == "") | F.col(g).endswith("*")
    p = cut(p)
    half = p.filter(loose("ga")).select(F.col("a").alias("n"), F.col("gb").alias("o")).unionByName(p.filter(loose("gb")).select(F.col("b").alias("n"), F.col("ga").alias("o")))
    torn = half.filter(~loose("o") & ~F.col("o").startswith("~")).groupBy("n").agg(F.min("o").alias("o1"), F.max("o").alias("o2")).filter("o1 <> o2").select("n", F.lit(True).alias("t"))
    p = p.join(torn.select(F.col("n").alias("a"), F.col("t").alias("ta")), "a", "left").join(torn.select(F.col("n").alias("b"), F.col("t").alias("tb")), "b", "left")
    return p.filter(F.col("sure") | (F.col("ta").isNull() & F.col("tb").isNull())).select("a", "b", "sim")


def average_linkage(nodes: DataFrame, pairs: DataFrame, threshold: float = LINKAGE) -> DataFrame:
    """(node, cluster) from pairs (a, b, sim); a pair that isn't given counts as 0. nodes: node, given, birth, death.

    The cluster's id is the smallest node in it. Equal averages are decided by the smaller id. Each round merges every
    pair of clusters that are each other's best, so the clusters at least halve along each chain; the loop ends when no
    pair at the threshold is left. Lineage is cut in each round.
    """
    state = cut(nodes.select("node", F.col("node").alias("cluster")))
    info = nodes.select(F.col("node").alias("c"), F.lit(1).cast("long").alias("n"), F.when(F.col("given").rlike("[*~]"), "").otherwise(F.col("given")).alias("given"), "birth", "death")
    linked = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "c")
    info = cut(info.join(linked, "c", "left_semi"))
    edges = cut(pairs.select("a", "b", F.col("sim").alias("s")))
    while True:
        side = lambda p: info.select(F.col("c").alias(p), *[F.col(x).alias(f"{p}_{x}") for x in ("n", "given", "birth", "death")])
        e = edges.join(side("a"), "a").join(side("b"), "b")
        fits = agree(F.col("a_birth"), F.col("b_birth")) & agree(F.col("a_death"), F.col("b_death")) & ((F.col("a_given") == "") | (F.col("b_given") == "") | (F.col("a_given") == F.col("b_given")))
        alive = cut(e.filter(fits).select("a", "b", "s", (F.col("s") / (F.col("a_n") * F.col("b_n"))).alias("avg")))  # a contradiction between clusters lasts
        good = alive.filter(F.col("avg") >= threshold)
        both = good.select(F.col("a").alias("c"), F.col("b").alias("o"), "avg").unionByName(good.select(F.col("b").alias("c"), F.col("a").alias("o"), "avg"))
        best = both.groupBy("c").agg(F.min(F.struct((-F.col("avg")).alias("x"), F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"))).alias("m"))
        merge = cut(best.groupBy("m.lo", "m.hi").agg(F.count(F.lit(1)).alias("k")).filter("k = 2").select(F.col("hi").alias("c"), F.col("lo").alias("to")))
        if merge.isEmpty():
            forget(alive, merge, info, edges)
            return state
        move = lambda df, c: df.join(merge.withColumnRenamed("c", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        old = (info, edges, state, alive, merge)
        info = cut(move(info, "c").groupBy("c").agg(F.sum("n").alias("n"), F.max("given").alias("given"), F.max("birth").alias("birth"), F.max("death").alias("death")))
        m = move(move(alive.select("a", "b", "s"), "a"), "b").filter("a <> b")
        edges = cut(m.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s")))
        state = cut(move(state, "cluster"))
        forget(*old)


def link_names(rows: DataFrame) -> DataFrame:
    """(key, cluster) of records (key, name, birth, death, place): one cluster per person or organisation.

    Null and blank names, and names that hold no word of three letters, get no row; equal names without anything that tells
    them apart are one; a key delivered twice is one record; an empty table gives an empty result; other columns are
    not read.
    """
    sig = ["initial", "surname", "given", "birth", "death", "place"]
    recs = cut(read_records(rows))
    # misspelt surnames stand under the usual spelling; organisations and persons apart
    org = F.when(F.col("initial").startswith("#"), F.col("initial")).otherwise("")
    words = recs.select(F.concat(org, "surname").alias("word"))
    spelt = usual_spelling(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    org = F.when(F.col("initial").startswith("#"), F.col("initial")).otherwise("")
    recs = recs.withColumn("word", F.concat(org, "surname")).join(spelt, "word", "left")
    recs = recs.withColumn("surname", F.coalesce(F.expr("substring(usual, length(word) - length(surname) + 1)"), "surname"))
    recs = cut(recs.select("key", *sig, F.xxhash64(*sig).alias("node"), F.xxhash64("initial", "surname").alias("form")))
    nodes = recs.groupBy("node", "form", *sig).agg(F.count(F.lit(1)).alias("n"))
    forms = cut(nodes.filter("initial <> ''").groupBy("form", "initial", "surname").agg(F.sum("n").alias("n")))
    # two surnames that are both usual are two surnames, however alike
    usual = forms.groupBy("surname").agg(F.sum("n").alias("usual"))
    named = forms.join(usual, "surname").select("form", "surname", "usual")
    # spellings one edit apart are found exactly, wherever; the cosine join adds those two edits apart, which count only where a date or
    # place confirms them, so they meet in blocks of a year or place
    vectors = cut(gram_vectors(forms.select("form", F.col("surname").alias("word"))))
    year = lambda c: F.when(F.col(c) != "", F.concat_ws("|", "initial", F.lit(c), F.substring(c, 1, 4)))
    marks = F.array(year("birth"), year("death"), F.when(F.col("place") != "", F.concat_ws("|", "initial", F.lit("place"), F.substring("place", 1, 3))))
    blocks = nodes.filter("initial <> ''").select("form", F.length("surname").alias("size"), F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("block")).filter("size >= 8").distinct()
    one = with_cosine(edit_pairs(forms.select("form", F.col("initial").alias("block"), F.lit("lr").alias("role"), F.col("surname").alias("word"))), vectors)
    two = similar_forms(vectors, blocks)
    e = one.withColumn("edits", F.lit(1)).unionByName(two.withColumn("edits", F.lit(2))).groupBy("a", "b").agg(F.min("edits").alias("edits"), F.max("cosine").alias("cosine"))
    e = e.join(named.select(F.col("form").alias("a"), F.col("surname").alias("sa"), F.col("usual").alias("ua")), "a").join(named.select(F.col("form").alias("b"), F.col("surname").alias("sb"), F.col("usual").alias("ub")), "b")
    e = e.filter(rare("ua", "ub")).filter((F.col("edits") == 1) | (swaps("sa", "sb") <= 2)).select("a", "b", "edits", "cosine")
    same = forms.select(F.col("form").alias("a"), F.col("form").alias("b"), F.lit(0).alias("edits"), F.lit(1.0).alias("cosine"))
    e = cut(e.unionByName(same))
    pairs = node_pairs(nodes, e)
    clusters = average_linkage(nodes, pairs)
    return recs.select("key", "node").join(clusters, "node").select("key", "cluster")


def pairs_of(clusters: DataFrame) -> DataFrame:
    """(key_a, key_b) of every two records of one cluster, the smaller key first."""
    a, b = clusters.select(F.col("key").alias("key_a"), "cluster"), clusters.select(F.col("key").alias("key_b"), "cluster")
    return a.join(b, "cluster").filter("key_a < key_b").select("key_a", "key_b")
