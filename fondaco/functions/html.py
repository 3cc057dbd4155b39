"""Column functions that read search and result pages: links, counts, cards, forms, signals. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, page_heading, strip_tags

_ANCHOR = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"
# What pages say when they let no one in, and when they found nothing.
BLOCKED = r"(?i)captcha|access denied|zugriff verweigert|accesso negato|too many requests|accès refusé"
NOTHING = r"(?i)no results|nessun risultato|keine (?:treffer|ergebnisse)|aucun résultat|0 results|ничего не найдено"


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def absolute(url: Column, base: str | Column) -> Column:
    """A link's address seen from a page's: whole ones stay, those from the root and beside the page are joined to it."""
    base = _c(base)
    root = F.regexp_extract(base, r"^(\w+://[^/]+)", 1)
    return F.when(url.rlike(r"^\w+://"), url).when(url.startswith("//"), F.concat(F.regexp_extract(base, r"^(\w+:)", 1), url)).when(url.startswith("/"), F.concat(root, url)).otherwise(F.concat(F.regexp_extract(base, r"^(\w+://.*/|\w+://[^/]+)", 1), F.when(base.rlike(r"^\w+://[^/]+$"), "/").otherwise(""), url))


def links(html: str | Column, base: str | Column) -> Column:
    """array<struct<url, label, css>> of anchors with a target, addresses made whole."""
    anchors = F.regexp_extract_all(_c(html), F.lit(_ANCHOR), F.lit(0))
    return F.transform(anchors, lambda a: F.struct(absolute(_attribute(a, "href"), base).alias("url"), strip_tags(a).alias("label"), _attribute(F.regexp_extract(a, r"(?is)^(<a\b[^>]*>)", 1), "class").alias("css")))


def _first_by_url(found: Column) -> Column:
    """The first of the links with one address, in order."""
    urls = F.array_distinct(F.transform(found, lambda x: x["url"]))
    return F.transform(urls, lambda u: F.element_at(F.filter(found, lambda x: x["url"] == u), 1))


def candidate_links(html: str | Column, base: str | Column, fragment: str = "", css: str = "", include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Links whose address holds a fragment, whose class has a token, and whose label or address passes the pattern lists; each address once."""
    keep = F.filter(links(html, base), lambda x: x["url"].contains(fragment) & (F.lit(not css) | F.array_contains(F.split(x["css"], r"\s+"), css)) & passes(x["label"], x["url"], include or [], exclude or []))
    return _first_by_url(keep)


def passes(title: Column, url: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether title or address match one of the patterns to include (if there are any) and none to exclude."""
    hit = lambda p: F.coalesce(title.rlike(p), F.lit(False)) | F.coalesce(url.rlike(p), F.lit(False))
    ok = F.lit(not include)
    for p in include:
        ok = ok | hit(p)
    for p in exclude:
        ok = ok & ~hit(p)
    return ok


def top_hits(html: str | Column, base: str | Column, query: str | Column, most: int = 5) -> Column:
    """Links to the page's own host whose labels share words with the query, the most shared first, then as they stand; array<struct<score, url, label>>."""
    host = F.regexp_extract(_c(base), r"^\w+://([^/]+)", 1)
    words = F.array_distinct(F.filter(F.split(F.lower(_c(query)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    own = _first_by_url(F.filter(links(html, base), lambda x: F.regexp_extract(x["url"], r"^\w+://([^/]+)", 1) == host))
    scored = F.transform(own, lambda x, i: F.struct((-F.size(F.array_intersect(F.split(F.lower(x["label"]), r"[^\p{L}\p{N}]+"), words))).alias("n"), i.alias("at"), x["url"].alias("url"), x["label"].alias("label")))
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["n"] < 0)), 1, most)
    return F.transform(best, lambda s: F.struct((-s["n"]).alias("score"), s["url"].alias("url"), s["label"].alias("label")))


def shown_counts(html: str | Column) -> Column:
    """struct<shown, total> of a "show n of m" line, else the number of links as both."""
    t = strip_tags(html)
    pattern = r"(?i)\b(?:show|showing|mostra|anzeige|affiche)\w*\D{0,12}(\d+)\D{1,8}(?:of|di|von|sur)\D{1,4}(\d+)"
    n = F.size(F.regexp_extract_all(_c(html), F.lit(_ANCHOR), F.lit(0)))
    got = F.regexp_extract(t, pattern, 1)
    return F.struct(F.when(got != "", got.cast("int")).otherwise(n).alias("shown"), F.when(got != "", F.regexp_extract(t, pattern, 2).cast("int")).otherwise(n).alias("total"))


def titled_links(html: str | Column, base: str | Column, fragment: str) -> Column:
    """Detail links with the nearest heading above each as its title; each address once: array<struct<url, title>>."""
    pieces = F.regexp_extract_all(_c(html), F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>|<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>"), F.lit(0))
    start = F.struct(F.lit("").alias("h"), F.array().cast("array<struct<url:string,title:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        url = absolute(_attribute(p, "href"), base)
        hit = p.rlike("(?i)^<a") & url.contains(fragment) & ~F.exists(acc["out"], lambda o: o["url"] == url)
        return F.struct(F.when(p.rlike("(?i)^<h"), strip_tags(p)).otherwise(acc["h"]).alias("h"), F.when(hit, F.concat(acc["out"], F.array(F.struct(url.alias("url"), acc["h"].alias("title"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def cards(html: str | Column, base: str | Column, css: str = "card") -> Column:
    """Cards of a class, each from its opening tag to the next one's: array<struct<title, url, text>>."""
    opening = rf"(?is)<(?:div|li|article)\b[^>]*\bclass\s*=\s*[\"'][^\"']*\b{css}\b[^\"']*[\"'][^>]*>"
    parts = F.slice(F.split(F.regexp_replace(_c(html), opening, "\u0001"), "\u0001"), 2, 1_000_000_000)
    card = lambda p: F.struct(strip_tags(F.regexp_extract(p, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1)).alias("title"), absolute(_attribute(p, "href"), base).alias("url"), strip_tags(p).alias("text"))
    return F.filter(F.transform(parts, card), lambda c: c["title"] != "")


def tree_nodes(xml: str | Column) -> Column:
    """Nodes of an archive's tree in a partial update: array<struct<id, label, leaf>>; the update's text is escaped markup."""
    t = F.regexp_replace(F.regexp_replace(_c(xml), r"<!\[CDATA\[|\]\]>", ""), "&lt;", "<")
    t = F.regexp_replace(F.regexp_replace(t, "&gt;", ">"), "&quot;", '"')
    tags = F.regexp_extract_all(t, F.lit(r"(?is)<li\b[^>]*\bdata-(?:rowkey|nodeid)\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</span>"), F.lit(0))
    node = lambda p: F.struct(F.regexp_extract(p, r"(?is)\bdata-(?:rowkey|nodeid)\s*=\s*[\"']([^\"']*)[\"']", 1).alias("id"), strip_tags(p).alias("label"), p.rlike(r"(?i)\bleaf\b").alias("leaf"))
    return F.transform(tags, node)


def panel_hits(html: str | Column) -> Column:
    """Label and value pairs of a side panel's definition list: array<struct<label, value>>."""
    pairs = F.regexp_extract_all(_c(html), F.lit(r"(?is)<dt\b[^>]*>.*?</dt>\s*<dd\b[^>]*>.*?</dd>"), F.lit(0))
    return F.transform(pairs, lambda p: F.struct(strip_tags(F.regexp_extract(p, r"(?is)<dt\b[^>]*>(.*?)</dt>", 1)).alias("label"), strip_tags(F.regexp_extract(p, r"(?is)<dd\b[^>]*>(.*?)</dd>", 1)).alias("value")))


def result_signals(html: str | Column, base: str | Column, fragment: str = "") -> Column:
    """struct<heading, links, shown, total, blocked, nothing> of a result page."""
    t = strip_tags(html)
    n = shown_counts(html)
    return F.struct(page_heading(html).alias("heading"), candidate_links(html, base, fragment).alias("links"), n["shown"].alias("shown"), n["total"].alias("total"), t.rlike(BLOCKED).alias("blocked"), t.rlike(NOTHING).alias("nothing"))


def form_fields(html: str | Column) -> Column:
    """Fields of a page's forms: array<struct<name, type, options>>; options are those of a choice, else none."""
    tags = F.regexp_extract_all(_c(html), F.lit(r"(?is)<select\b[^>]*>.*?</select>|<(?:input|textarea)\b[^>]*>"), F.lit(0))
    kind = lambda t: F.when(t.rlike("(?i)^<select"), "choice").when(t.rlike("(?i)^<textarea"), "text").otherwise(F.coalesce(F.nullif(F.lower(_attribute(t, "type")), F.lit("")), F.lit("text")))
    options = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<option\b[^>]*>"), F.lit(0)), lambda o: _attribute(o, "value"))
    fields = F.transform(tags, lambda t: F.struct(_attribute(F.regexp_extract(t, r"(?is)^(<[^>]*>)", 1), "name").alias("name"), kind(t).alias("type"), options(t).alias("options")))
    return F.filter(fields, lambda f: f["name"] != "")


def form_changes(before: Column, after: Column) -> Column:
    """Fields that two versions of a form don't share alike: array<struct<name, change>> with added, removed, changed."""
    names = F.array_sort(F.array_distinct(F.concat(F.transform(before, lambda f: f["name"]), F.transform(after, lambda f: f["name"]))))
    at = lambda fields, n: F.get(F.filter(fields, lambda f: f["name"] == n), 0)
    change = lambda n: F.struct(n.alias("name"), F.when(at(before, n).isNull(), "added").when(at(after, n).isNull(), "removed").when(at(before, n) != at(after, n), "changed").alias("change"))
    return F.filter(F.transform(names, change), lambda c: c["change"].isNotNull())
