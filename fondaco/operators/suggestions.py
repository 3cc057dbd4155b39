"""Nearest terms of a lexicon within a few edits, by deletion neighbourhoods: exact, without pairs of all words and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _less(words: Column) -> Column:
    """All words of an array with one letter left out of each."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), cut)))


def deletions(word: Column, edits: int) -> Column:
    """The word and every word that is left when up to ``edits`` letters are dropped."""
    out = last = F.array(word)
    for _ in range(edits):
        last = _less(last)
        out = F.concat(out, last)
    return F.array_distinct(out)


def nearest_terms(words: DataFrame, terms: DataFrame, edits: int = 2) -> DataFrame:
    """(word, term, edits) of different words (word, distinct) and terms (term, distinct) at most so many edits apart.

    Two strings within k edits have a common string that is left when each drops up to k letters, so they meet by those in an equi-join; the
    distance is then computed. Null words and terms give no rows.
    """
    w = words.select("word", F.explode(deletions(F.col("word"), edits)).alias("key"))
    t = terms.select("term", F.explode(deletions(F.col("term"), edits)).alias("key"))
    met = w.join(t, "key").filter("word <> term").select("word", "term").distinct()
    d = F.levenshtein("word", "term", edits)
    return met.withColumn("edits", d).filter("edits >= 0")
