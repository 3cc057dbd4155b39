"""Phrases of a list found in texts: equi-joins on runs of tokens, never texts times phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_tokens


def phrase_form(c: str | Column) -> Column:
    """A phrase as it is looked for: its lower-case tokens with single blanks, so case and punctuation don't count."""
    return F.array_join(word_tokens(c), " ")


def turned(c: str | Column) -> Column:
    """A form with its last token first, as names in registers stand; null for a single token."""
    t = F.split(c, " ")
    return F.when(F.size(t) > 1, F.array_join(F.concat(F.slice(t, -1, 1), F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(1)))), " "))


def phrase_matches(docs: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """(key, form, pos) of each place (token number from 0) where a form of ``phrases`` (form, distinct) stands in a text.

    A text is cut in its runs of as many tokens as some form has, and the runs meet the forms in an equi-join. The lengths of the forms are
    few, so a text gives a small multiple of its tokens. Null texts and forms give no rows.
    """
    p = phrases.select("form").filter(F.col("form") != "").distinct()
    sizes = [r.n for r in p.select(F.size(F.split("form", " ")).alias("n")).distinct().collect()]  # the few lengths of forms in tokens
    if not sizes:
        return docs.select(key, F.lit("").alias("form"), F.lit(0).cast("long").alias("pos")).filter("false")
    t = docs.select(key, word_tokens(text).alias("t")).filter(F.size("t") > 0)
    def runs_of(n: int) -> DataFrame:
        run = F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), lambda i: F.array_join(F.slice("t", i, n), " "))
        return t.filter(F.size("t") >= n).select(key, F.posexplode(run).alias("pos", "form"))

    runs = [runs_of(n) for n in sorted(sizes)]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.join(p, "form").select(key, "form", F.col("pos").cast("long").alias("pos"))


def name_tier(text: str | Column, name: str | Column) -> Column:
    """exact, normalised or reversed: how a name stands in a text, null where it doesn't."""
    text, name = (F.col(x) if isinstance(x, str) else x for x in (text, name))
    within = F.concat(F.lit(" "), phrase_form(text), F.lit(" "))
    has = lambda f: within.contains(F.concat(F.lit(" "), f, F.lit(" ")))
    form = phrase_form(name)
    bounded = (form != "") & has(form)
    return F.when(bounded & text.contains(name), "exact").when(bounded, "normalised").when(has(turned(form)), "reversed")
