"""Matching register rows and titles without a shared key: BM25 retrieval, mutual-nearest test, calibrated confidence.

Register rows are documents of attribute tokens (surname, given name, initial, and the dates of birth and death to year,
month and day); titles are read for the person they name and become queries of the same tokens. Surnames are first
led to their usual spelling over both tables, and a rare spelling also asks for register surnames within an edit.

Retrieval is exact and pruned by a bound: a pair whose dates, initial or given names contradict can't be a match whatever it scores, so
each title asks only for the postings that are left: a surname's list is split by initial and, where both sides know them, by year of
birth, year of death and given name (:func:`_keys`). A surname with a third of all rows is thus never met as a whole, and no pair is met
that isn't a candidate. Both full dates and the initial also retrieve, for surnames that are written quite differently.
Scores are summed over all tokens; no k and no least score cut any off, as idf falls with the size of the register.

A title keeps its nearest row, ties, and rows that agree with it (a person entered twice); a row keeps its nearest title and the
titles that don't contradict that one, as a row is one person. The gap to the next person gives the confidence, and pairs below
CONFIDENT are cut.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, shuffled, spread
from .linkage import _given_factor, agree, edit_pairs, rare, usual_spelling
from .names import parse_date, parse_dates, parse_name

K1, B = 1.2, 0.3
#: Rows that calibrate the confidence at most (the first by a hash of their keys); confidence that a pair must reach.
SAMPLE, CONFIDENT = 5_000, 0.05
#: Edits between surnames that both full dates and the initial bridge.
FAR_EDITS = 3

# What kinds of document on one person are called, by language.
KINDS = re.compile(
    r"^\s*(?:(?:lapide|scheda biografica|necrologio)(?:\s+(?:di|del|della)\b)?|(?:service papers|obituary)(?:\s+of\b)?|avis de décès(?:\s+de\b)?"
    r"|fascicolo personale|foglio matricolare|partigiani caduti|estratto (?:dell')?atto di morte|estratto di morte|atto di morte|certificato di morte|acte de décès|dossier individuel|fiche individuelle|livret militaire"
    r"|personalakte|verlustmeldung|grabmeldung|sterbeurkunde|sterbebucheintrag|gräberkarte|todesanzeige|casualty record|casualty form|grave registration|death certificate|личное дело|карточка)\s*[:,–—-]?\s*",
    re.I,
)
_BIRTH = re.compile(r"(?:\b(?:nato|nata|n|geb|geboren|born|b|classe|cl|né|née|р)\b\.?|\*)\s*(?:il|in|nel|le|am|on|a)?\s*$", re.I)
_DEATH = re.compile(r"(?:\b(?:m|morto|morta|caduto|caduta|gef|gefallen|gest|gestorben|d|died|killed|décédé|décédée|mort|morte|ум|погиб)\b\.?|†|\+)\s*(?:il|in|nel|le|am|on)?\s*$", re.I)
_END = re.compile(r"[,;]?\s+(?:nato|nata|n\.|geb\.|geboren|born|b\.|classe|cl\.|né|née|m\.|morto|morta|caduto|caduta|gef\.|gest\.|d\.|died|†|\+|dichiarazione|décédé)\s|[,;]?\s*[†+(]|\s+\d|,\s*dichiarazione", re.I)


def title_person(title: str | None) -> tuple[str, str, str, str, str] | None:
    """(initial, surname, given, birth, death) of the person whom a title names, None if it can't be read as one."""
    if not title or not title.strip():
        return None
    s = KINDS.sub("", title.strip())
    found = parse_dates(s)
    birth = death = ""
    low = s.lower()
    span = next((k for k in range(len(found) - 1) if re.fullmatch(r"\s*[–/-]\s*", low[found[k][2] : found[k + 1][0]])), None)
    if span is not None:  # from and to
        birth, death = found[span][1], found[span + 1][1]
    else:
        for at, date, _ in found:
            if _BIRTH.search(low[:at]):
                birth = birth or date
            elif _DEATH.search(low[:at]):
                death = death or date
    cut_at = _END.search(s)
    name = s[: cut_at.start()] if cut_at else s
    r = parse_name(name) if name.strip() else None
    if r is None or r[0] != "person":
        return None
    return r[1], r[2], r[3], birth, death


def _read(df: DataFrame, key: str, cols: list[str], read) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, *r) for k, *v in zip(pdf[key], *[pdf[c] for c in cols]) if (r := read(*v))]
            yield pd.DataFrame(out, columns=["key", "initial", "surname", "given", "birth", "death"]).astype({"key": pdf[key].dtype})

    return spread(df.select(key, *cols).filter(F.col(key).isNotNull()).distinct(), key).mapInPandas(run, f"key {kind}, initial string, surname string, given string, birth string, death string").distinct()


def _row(nome: str | None, nascita: str | None, morte: str | None):
    r = parse_name(nome) if nome and nome.strip() else None
    return (r[1], r[2], r[3], parse_date(nascita), parse_date(morte)) if r and r[0] == "person" else None


def _tokens(df: DataFrame) -> DataFrame:
    """key, t: one row per attribute token; s: comes apart, as it has neighbours."""
    t = lambda p, c, n: F.when(F.length(c) >= n, F.concat(F.lit(p), F.substring(c, 1, n)))
    parts = F.array(F.when(F.col("initial") != "", F.concat(F.lit("i:"), "initial")), F.when((F.col("given") != "") & ~F.col("given").rlike("[*~]"), F.concat(F.lit("g:"), "given")), *[t(f"{p}{n}:", c, n) for p, c in (("b", "birth"), ("d", "death")) for n in (4, 7, 10)])
    return df.select("key", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("t"))


def _loose(c: str) -> Column:
    """Whether a given name may stand for several: none, an initial, a cut one, one that isn't in the lists."""
    return (F.col(c) == "") | F.col(c).rlike("[*~]")


def _keys(df: DataFrame, title: bool) -> DataFrame:
    """df with a row per retrieval key ``k``; a title and a row share one exactly if their surname and initial agree and neither their
    years of birth, nor of death, nor whole given names contradict, or if both full dates and the initial agree.

    A pair meets under its years of birth if both are known, else under its years of death if both are, else under its given names.
    Sides without a year ask for, or answer to, each kind of knowledge that the other side may have.
    """
    b, d = F.col("birth") != "", F.col("death") != ""
    have = F.concat(b.cast("int").cast("string"), d.cast("int").cast("string"))
    name, by = F.concat_ws("|", "surname", "initial"), F.col("birth").substr(1, 4)
    dy = F.col("death").substr(1, 4)
    kinds = lambda *k: F.array(*map(F.lit, k))
    if title:
        born = F.when(b, F.array(F.concat_ws("|", F.lit("b"), name, by)))
        # where either has no birth: the row's kinds of knowledge that a title's leaves for the years of death
        died = F.when(d, F.transform(F.when(b, kinds("01")).otherwise(kinds("01", "11")), lambda h: F.concat_ws("|", F.lit("d"), name, h, dy)))
        open_ = F.when(b & d, kinds("00")).when(b, kinds("00", "01")).when(d, kinds("00", "10")).otherwise(kinds("00", "01", "10", "11"))
        given = F.when(_loose("given"), kinds("any")).otherwise(F.array(F.col("given"), F.lit("loose")))
    else:
        born = F.when(b, F.array(F.concat_ws("|", F.lit("b"), name, by)))
        died = F.when(d, F.array(F.concat_ws("|", F.lit("d"), name, have, dy)))
        open_ = F.array(have)
        given = F.array(F.when(_loose("given"), F.lit("loose")).otherwise(F.col("given")), F.lit("any"))
    bare = F.flatten(F.transform(open_, lambda h: F.transform(given, lambda g: F.concat_ws("|", F.lit("g"), name, h, g))))
    full = (F.length("birth") == 10) & (F.length("death") == 10)
    far = F.when(full & F.col("own"), F.array(F.concat_ws("|", F.lit("f"), "initial", "birth", "death")))
    none = F.array().cast("array<string>")
    # a surname alone meets by full dates only
    alone = F.filter(F.array(*[F.when(F.length(c) == 10, F.concat_ws("|", F.lit("a"), "surname", F.lit(c), F.col(c))) for c in ("birth", "death")]), lambda k: k.isNotNull())
    with_initial = F.concat(F.coalesce(born, none), F.coalesce(died, none), bare, F.coalesce(far, none))
    keys = F.when(F.col("initial") == "", alone).otherwise(with_initial if title else F.concat(with_initial, alone))
    return df.withColumn("k", F.explode(keys))


def match_titles(register: DataFrame, titles: DataFrame, id_col: str, name: str, birth: str, death: str, doc_col: str, title: str) -> DataFrame:
    """(row id, document id, score, gap, confidence) of every title and register row about one person.

    Nulls, blanks and unreadable names or titles match nothing; rows delivered twice count once; a person entered twice
    in the register matches with both rows; rows that tie all match; empty tables give no rows; other columns are
    not read.
    """
    reg = _read(register, id_col, [name, birth, death], _row)
    # a row delivered twice with other spellings: the smallest reading stands for it
    reg = reg.groupBy("key").agg(F.min(F.struct("initial", "surname", "given", "birth", "death")).alias("r")).select("key", "r.*")
    doc = _read(titles, doc_col, [title], title_person)
    doc = doc.groupBy("key").agg(F.min(F.struct("initial", "surname", "given", "birth", "death")).alias("r")).select("key", "r.*")
    reg, doc = cut(reg), cut(doc)
    words = reg.select(F.col("surname").alias("word")).unionByName(doc.select(F.col("surname").alias("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    spelt = cut(usual_spelling(words))
    fix = lambda df: df.join(spelt, F.col("surname") == F.col("word"), "left").withColumn("surname", F.coalesce("usual", "surname")).drop("word", "usual")
    reg, doc = cut(fix(reg)), cut(fix(doc))
    # rare surnames of either side within an edit of each other, under one initial
    forms = lambda df, role: df.select("initial", "surname").distinct().select(F.xxhash64(F.lit(role), "initial", "surname").alias("form"), F.col("initial").alias("block"), F.lit(role).alias("role"), F.col("surname").alias("word"))
    fl, fr = forms(doc, "l"), forms(reg, "r")
    usual = reg.select("surname").unionByName(doc.select("surname")).groupBy("surname").agg(F.count(F.lit(1)).alias("n"))
    near = edit_pairs(fl.unionByName(fr))
    near = near.join(fl.select(F.col("form").alias("a"), F.col("word").alias("sa")), "a").join(fr.select(F.col("form").alias("b"), F.col("word").alias("sb")), "b").filter("sa <> sb")
    near = near.select("sa", "sb").distinct()
    near = near.join(usual.select(F.col("surname").alias("sa"), F.col("n").alias("na")), "sa").join(usual.select(F.col("surname").alias("sb"), F.col("n").alias("nb")), "sb")
    near = cut(near.filter(rare("na", "nb")).select("sa", "sb"))
    # index
    d = _tokens(reg).unionByName(reg.select("key", F.concat(F.lit("s:"), "surname").alias("t")))
    size = d.groupBy("key").agg(F.count(F.lit(1)).alias("len"))
    stats = size.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()  # two numbers
    n_rows, avg = stats["n"] or 0, stats["avg"] or 1.0
    df = d.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("t", F.log(1 + (F.lit(float(n_rows)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    imp = d.join(shuffled(size), "key").join(shuffled(idf), "t").select(F.col("key").alias("row"), "t", (F.col("idf") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("len") / avg))).alias("w"))
    imp = cut(imp)
    own = doc.select("key", F.concat(F.lit("s:"), "surname").alias("t"), F.lit(1.0).alias("q"))
    others = doc.join(near, doc["surname"] == near["sa"]).select("key", F.concat(F.lit("s:"), "sb").alias("t"), F.lit(0.8).alias("q"))
    q = own.unionByName(others).unionByName(_tokens(doc).withColumn("q", F.lit(1.0)))
    q = cut(q)
    # titles under their own surname and under those an edit away
    sides = doc.withColumn("own", F.lit(True)).unionByName(doc.join(near, doc["surname"] == near["sa"]).withColumn("surname", F.col("sb")).drop("sa", "sb").withColumn("own", F.lit(False)))
    pairs = _keys(sides, True).select(F.col("key").alias("doc"), "k").join(shuffled(_keys(reg.withColumn("own", F.lit(True)), False).select(F.col("key").alias("row"), "k")), "k").select("doc", "row").distinct()
    side = lambda df, p, k: df.select(F.col("key").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in ("initial", "surname", "given", "birth", "death")])
    qv = q.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("t", "q"))).alias("qv")).withColumnRenamed("key", "doc")  # a dozen tokens at most, and near surnames
    iv = imp.groupBy("row").agg(F.collect_list(F.struct("t", "w")).alias("iv"))
    score = F.aggregate("iv", F.lit(0.0), lambda acc, x: acc + x["w"] * F.coalesce(F.element_at("qv", x["t"]), F.lit(0.0)))
    s = pairs.join(shuffled(qv), "doc").join(shuffled(iv), "row").withColumn("score", score).drop("qv", "iv")
    s = s.join(side(doc, "t", "doc"), "doc").join(side(reg, "r", "row"), "row")
    near_names = near.select(F.col("sa").alias("t_surname"), F.col("sb").alias("r_surname"), F.lit(True).alias("near"))
    s = s.join(near_names, ["t_surname", "r_surname"], "left")
    full = ((F.length("t_birth") == 10) & (F.col("t_birth") == F.col("r_birth"))) | ((F.length("t_death") == 10) & (F.col("t_death") == F.col("r_death")))
    g = F.when(F.col("t_initial") == F.col("r_initial"), _given_factor(F.col("t_given"), F.col("r_given"))).when((F.col("t_initial") == "") & full, 0.75)
    s = s.withColumn("g", g)
    far = (F.col("t_birth") == F.col("r_birth")) & (F.col("t_death") == F.col("r_death")) & full & (F.length("t_surname") >= 2 * FAR_EDITS) & (F.levenshtein("t_surname", "r_surname") <= FAR_EDITS)
    same = ((F.col("t_surname") == F.col("r_surname")) | F.coalesce("near", F.lit(False)) | far) & F.col("g").isNotNull() & agree(F.col("t_birth"), F.col("r_birth")) & agree(F.col("t_death"), F.col("r_death"))
    dated = ((F.length("t_birth") >= 4) & (F.length("r_birth") >= 4)) | ((F.length("t_death") >= 4) & (F.length("r_death") >= 4))
    s = cut(s.withColumn("ok", F.coalesce(same, F.lit(False))).withColumn("dated", dated))
    # the nearest of each side; among readings that a title allows, a contradiction to the nearest one is another person
    by_doc = Window.partitionBy("doc")
    ok = s.filter("ok").withColumn("best", F.max("score").over(by_doc))
    whole = (F.col("r_given") != "") & ~F.col("r_given").rlike("[*~]")
    ok = ok.withColumn("g1", F.min(F.when(whole, F.col("r_given"))).over(by_doc)).withColumn("g2", F.max(F.when(whole, F.col("r_given"))).over(by_doc))
    lead = F.max(F.struct("score", "r_given", "r_birth", "r_death", "row")).over(by_doc)
    ok = ok.withColumn("lead", lead)
    alike = agree(F.col("r_birth"), F.col("lead.r_birth")) & agree(F.col("r_death"), F.col("lead.r_death"))
    loose = (F.col("t_given") == "") | F.col("t_given").endswith("*")
    # rows that only an undated nearest row lets stand side by side are different persons: the nearest and its ties stay
    ok = ok.withColumn("alike", alike)
    top = lambda c: F.max(F.when(F.col("alike"), F.col(c))).over(by_doc)
    ok = ok.withColumn("top_birth", top("r_birth")).withColumn("top_death", top("r_death"))
    one = F.min(F.when(F.col("alike"), agree(F.col("r_birth"), F.col("top_birth")) & agree(F.col("r_death"), F.col("top_death")))).over(by_doc)
    ok = ok.withColumn("one", one)
    kept = ok.filter((F.col("alike") & F.col("one")) | (F.col("score") == F.col("best"))).filter(~loose | F.col("dated") | F.col("g1").isNull() | (F.col("g1") == F.col("g2")))
    # the row's side: a title that contradicts the row's nearest one names another person
    kept = cut(kept)
    named = F.when(_loose("t_given"), F.lit("")).otherwise(F.col("t_given"))
    nearest = kept.groupBy("row").agg(F.max(F.struct("score", named.alias("given"), F.col("t_birth").alias("birth"), F.col("t_death").alias("death"))).alias("n"))
    kept = kept.join(nearest, "row")
    fits = agree(F.col("t_birth"), F.col("n.birth")) & agree(F.col("t_death"), F.col("n.death")) & ((named == "") | (F.col("n.given") == "") | (named == F.col("n.given")))
    kept = kept.filter(fits | (F.col("score") == F.col("n.score")))
    # gap to the nearest row that is another person
    other = s.join(kept.select("doc", "row", F.lit(True).alias("k")), ["doc", "row"], "left").filter("k is null").groupBy("doc").agg(F.max("score").alias("second"))
    out = cut(kept.join(other, "doc", "left").select("row", "doc", "score", (F.col("score") - F.coalesce("second", F.lit(0.0))).alias("gap"), "dated", "g"))
    a0, a1, a2 = calibrate(out)
    conf = 1 / (1 + F.exp(-(a0 + a1 * F.col("gap") + a2 * F.col("score"))))
    return out.select(F.col("row").alias(id_col), F.col("doc").alias(doc_col), "score", "gap", conf.alias("confidence")).filter(F.col("confidence") >= CONFIDENT)


def calibrate(pairs: DataFrame, rows: int = SAMPLE) -> tuple[float, float, float]:
    """Logistic weights of (1, gap, score), fitted to at most ``rows`` pairs.

    Pairs whose dates confirm a whole given name are taken for right; each is set against its runner-up, whose gap is
    the negative of its own. The fit is Newton's, with a small ridge; without pairs a fixed gentle curve stands in.
    """
    got = pairs.filter("dated AND g >= 1.0").orderBy(F.xxhash64("doc", "row"), "doc", "row").limit(rows).select("gap", "score").toPandas()
    if len(got) < 20:
        return 0.0, 0.3, 0.0
    x = np.vstack([np.column_stack([np.ones(len(got)), got.gap, got.score]), np.column_stack([np.ones(len(got)), -got.gap, got.score - got.gap])])
    y = np.r_[np.ones(len(got)), np.zeros(len(got))]
    scale = np.array([1.0, *(x[:, 1:].std(axis=0) + 1e-9)])
    x, w = x / scale, np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * len(got) / 100 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * len(got) / 100 * w)
    a = w / scale
    return tuple(float(v) if math.isfinite(v) else 0.0 for v in a)
