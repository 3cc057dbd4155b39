"""Main body of web pages: two passes of block rules over the lines of a page.

Pass 1 decides single blocks (lines) by stop-word density, length and link density. The plain text has no tags any
more, so link text is learned: a line or a separated part of a line that stands on a fifth of a site's pages (less what few
pages leave uncertain) is a link or notice of that site, and a block's link density is the share of its parts that are. No list
of labels is used. What links leave behind counts too: list bullets, cut teasers. Pass 2 gives the ambiguous short
blocks (names, headings, bare numbers) the label of their nearest decided neighbours, runs of them together; a heading that
two kinds of neighbour claim stays in the body.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Frequent function words, by language.
STOP_WORDS = frozenset(
    """
il lo la i gli le un una uno di a da in con su per tra fra e o ma non che si al alla alle ai dal dalla del della dei delle degli nel nella nei sul sulla è fu furono come più quale quali cui suo sua ne ci
the a an of to in on at by for from with and or but not that which was were is are had has have his her their its it as be been no one they them near some
der die das den dem des ein eine einer eines einem einen und oder aber nicht ist sind war wurde wurden von vom zu zum zur mit bei nach aus auf im in am an für als dass seit laut keiner wird sich
le la les un une des du de au aux et ou mais ne pas que qui est sont fut était dans sur par pour avec sans vers près se en son sa ses leur d l s plusieurs dont
и в во на не с со к ко у о об из за по до от был была было были что как без года под для его их о
""".split()
)
COPYRIGHT = re.compile(r"^\W*(?:©|copyright\b)", re.I)
BULLET = re.compile(r"^[›•▸»■▪◦‣]\s*\S|^[-–*]\s+(?=[A-ZÀ-Ý])(?!.*[-–]$)")
CUT = re.compile(r"(?:…|\.\.\.)$")
DATED = re.compile(r"^[^\d.;:]{3,45}, \d{4}$")
YEAR = re.compile(r"\s\(\d{4}\)$")
NAME = re.compile(r"^(?:[A-ZÀ-ÝŠŽА-ЯЁ][\w'’.-]*)(?:\s(?:di|de|del|della|von|van|du|la|le|[A-ZÀ-ÝŠŽА-ЯЁ][\w'’.-]*)){0,5}(?:\s\(\d{4}\))?$")
#: Words of a name list at least; items of a side list that comes between paragraphs at most.
LIST_LEAST, SIDE_MOST = 3, 3

#: Share of a site's pages on which a link text stands; share of the sites that make it one everywhere, and their least number.
SITE_SHARE, SITES_SHARE, SITES = 0.2, 0.02, 3
#: Pages (at least, and their share) that make a line a repeated one; share of a line's sides beside repeated lines or a page's end,
#: and share of some site's pages, that make it a link text everywhere. Fitted to the pages of the test tables: headings of a text
#: have up to 0.36 and labels 0.39 and more, titles of works stand on up to 0.02 of a site's pages.
REPEATED, REPEATED_SHARE, BESIDE, COMMON = 5, 0.001, 0.385, 0.06

GOOD, BAD, MAYBE = "good", "bad", "maybe"
_SPLIT = r"\s*[|·•»›>]\s*|\s+/\s+|\s{2,}"
_SEPARATED = re.compile(_SPLIT)
_SPACE = r"[ \t\r\u00a0]+"
#: Hashes of link texts (see :func:`text_key`).
Labels = frozenset[int]


@lru_cache(maxsize=100_000)
def text_key(text: str) -> int:
    """Hash of a line or part as link texts are counted: lower case, digits masked, blanks squeezed; the same as Spark's of it."""
    h = xxhash.xxh64_intdigest(re.sub(_SPACE, " ", re.sub(r"[0-9]+", "0", text.lower())).strip(" ").encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def label_keys(*texts: str) -> Labels:
    return frozenset(map(text_key, texts))


def _parts(line: str) -> list[str]:
    return [p for p in _SEPARATED.split(line) if p]


def count_texts(pages: DataFrame, site: str, text: str) -> DataFrame:
    """(site, h, whole, n): on how many of a site's pages a line (whole) or a separated part of one stands, by hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            for u, t in zip(pdf["site"], pdf["text"]):
                lines = [x for x in map(str.strip, t.split("\n")) if any(map(str.isalpha, x))]
                whole = set(map(text_key, lines))
                parts = {text_key(p) for x in lines for p in (_parts(x) if _SEPARATED.search(x) else ())} - whole
                n.update((u, h, True) for h in whole)
                n.update((u, h, False) for h in parts)
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["site", "h", "whole", "n"])

    p = pages.select(F.coalesce(F.col(site), F.lit("")).alias("site"), F.col(text).alias("text"))
    return p.mapInPandas(run, "site string, h long, whole boolean, n long").groupBy("site", "h", "whole").agg(F.sum("n").alias("n")).filter("n > 1")


def beside(pages: DataFrame, text: str, repeated: Labels) -> DataFrame:
    """(h, seen, near): occurrences of repeated lines, and their sides at which a repeated line or a page's end stands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen, near = Counter(), Counter()
            for t in pdf["text"]:
                lines = [x for x in map(str.strip, t.split("\n")) if x]
                hs = list(map(text_key, lines))
                mark = [True, *(h in repeated or len(_SEPARATED.split(x)) > 2 for h, x in zip(hs, lines)), True]
                for j, h in enumerate(hs):
                    if h in repeated:
                        seen[h] += 1
                        near[h] += mark[j] + mark[j + 2]
            yield pd.DataFrame([(h, n, near[h]) for h, n in seen.items()], columns=["h", "seen", "near"])

    return pages.select(F.col(text).alias("text")).mapInPandas(run, "h long, seen long, near long").groupBy("h").agg(F.sum("seen").alias("seen"), F.sum("near").alias("near"))


def link_texts(pages: DataFrame, site: str, text: str) -> tuple[DataFrame, Labels]:
    """(site, h) of each site's link texts, by hash, and the link texts that count on every page.

    A site's own stand on SITE_SHARE of its pages, so it has at most 1 / SITE_SHARE times as many as lines and parts on its average
    page. Everywhere count those of several sites, and lines that stand on COMMON of some site's pages and mostly beside
    other repeated lines; both are bounded by shares as well. Shares are less three quarters of 1 / sqrt(pages).
    """
    pages = pages.filter(F.trim(text) != "")
    size = pages.groupBy(F.coalesce(F.col(site), F.lit("")).alias("site")).agg(F.count(F.lit(1)).alias("pages"))
    counts = cut(count_texts(pages, site, text).join(size, "site").withColumn("sure", F.col("n") / F.col("pages") - 0.75 / F.sqrt("pages")))
    own = counts.filter(F.col("sure") >= SITE_SHARE).select("site", "h").distinct()
    totals = size.agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("sites")).first()
    shared = own.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(SITES, SITES_SHARE * totals.sites))
    rep = counts.filter("whole").groupBy("h").agg(F.sum("n").alias("n"), F.max("sure").alias("sure")).filter(F.col("n") >= max(REPEATED, REPEATED_SHARE * (totals.pages or 0)))
    rep = {r.h: r.sure for r in rep.collect()}
    near = beside(pages, text, frozenset(rep)).filter(F.col("near") >= 2 * BESIDE * F.col("seen")).select("h").collect() if rep else []
    return own, frozenset([r.h for r in shared.collect()] + [r.h for r in near if rep[r.h] >= COMMON])



def link_density(line: str, labels: Labels) -> tuple[float, int]:
    """Share of a line's separated parts that are link texts, and the number of parts; the whole line may be one."""
    if text_key(line) in labels:
        return 1.0, 1
    parts = [p.strip() for p in _SEPARATED.split(line) if p.strip()]
    return (sum(text_key(p) in labels for p in parts) / len(parts), len(parts)) if len(parts) > 1 else (0.0, len(parts))


def menu(line: str, labels: Labels) -> bool:
    """Whether a line's link density makes it a menu or a path: a path's last part is the page itself."""
    density, n = link_density(line, labels)
    if density and density * n >= min(n - 1, 0.5 * n):
        return True
    short = n >= 3 and all(len(p.split()) <= 4 for p in _SEPARATED.split(line))
    return short and bool(re.search(r"[|·•»›>]|\s/\s", line)) and not re.search(r"\d{2}", line)


def decide(line: str, title: str, labels: Labels) -> str:
    """Pass 1: the label of one line by itself."""
    if title and line.lower() == title:
        return GOOD
    if menu(line, labels) or COPYRIGHT.match(line):
        return BAD
    if BULLET.match(line) or (CUT.search(line) and not re.search(r"\.{4,}$", line)):
        return BAD
    if DATED.match(line) and NAME.match(line.rpartition(",")[0]):
        return BAD
    words = re.findall(r"[^\W\d_]+", line.lower())
    stop = sum(w in STOP_WORDS for w in words)
    if len(words) >= 5 and stop >= 0.12 * len(words):
        return GOOD
    if re.search(r"[.!?,;¬-]$", line) and len(words) >= 1 and (stop or len(words) >= 2):
        return GOOD
    if re.search(r"\.{3,}\s*\d|[·_]{3,}\s*\d", line):  # a list with leaders
        return GOOD
    if len(words) >= 7:
        return GOOD
    return MAYBE


def named(line: str) -> bool:
    """Whether a line may be an entry of a list of names: two capitalised words or more and no capitals throughout."""
    return bool(NAME.match(line)) and " " in line and not line.isupper()


def furniture(text: str | None, title: str | None = None, site: str | None = None, labels: Labels = frozenset()) -> list[int]:
    """Numbers (from 0) of the non-blank lines of a page that are not main body; labels: the site's link texts."""
    if not text:
        return []
    lines = [(k, x.strip()) for k, x in enumerate(text.split("\n")) if x.strip()]
    head = (title or "").strip().lower()
    marks = [decide(x, head, labels) for _, x in lines]
    n = len(lines)
    # the page's own title: the last part of a path above the first running text
    if not head:
        for (_, x), mark in zip(lines, marks):
            parts = [p.strip() for p in re.split(r"\s*[›»>]\s*|\s+/\s+", x) if p.strip()]
            if len(parts) >= 2 and text_key(parts[0]) in labels and text_key(parts[-1]) not in labels:
                head = parts[-1].lower()
            if mark == GOOD:
                break
    sites = {(site or "").lower()} | {m[1].strip().lower() for _, x in lines if (m := re.match(r"^\W*(?:©|copyright)\s*\d{4}\s+(.+?)(?:\s+[–-]\s+|\.|$)", x, re.I))}
    sites.discard("")
    first_text = next((i for i in range(n) if marks[i] == GOOD and lines[i][1].lower() != head), n)
    menus = [i for i in range(first_text) if marks[i] == BAD]
    for i in range(n):
        x = lines[i][1].lower()
        if head and x == head:
            marks[i] = GOOD
        elif x in sites:
            marks[i] = BAD
        elif marks[i] == MAYBE and i < first_text and NAME.match(lines[i][1]) and menus and i < menus[-1] and (i < menus[0] or i <= 1):
            marks[i] = BAD  # the site's name stands above its menu
    # pass 2: ambiguous blocks from their nearest decided neighbours
    out = list(marks)
    i = 0
    while i < n:
        if marks[i] != MAYBE:
            i += 1
            continue
        j = i
        while j < n and marks[j] == MAYBE:
            j += 1
        before = marks[i - 1] if i else None
        after = marks[j] if j < n else None
        out[i:j] = _run([x for _, x in lines[i:j]], before, after, i <= first_text and j >= first_text)
        i = j
    return [k for (k, _), m in zip(lines, out) if m == BAD]


def _run(run: list[str], before: str | None, after: str | None, top: bool) -> list[str]:
    """Labels of a run of ambiguous lines between two decided ones."""
    n = len(run)
    if before != BAD and after != BAD:
        return [GOOD] * n
    names = 0
    while names < n and named(run[names]):
        names += 1
    if top and after == GOOD:  # title and headings between the menu and the first paragraph
        return [GOOD] * n
    if before == BAD:
        side = [k for k in range(names) if YEAR.search(run[k])]
        closed = after == BAD or after is None
        if closed and names < n and names < LIST_LEAST and not side:
            return [BAD] * names + [GOOD] * (n - names)
        # entries of a side list come first, and only they bear years; a list of the page's own names may follow
        few = names < LIST_LEAST if closed else names <= SIDE_MOST
        cut = names if few else (side[-1] + 1 if side else 0)
        if names > cut and names - cut < LIST_LEAST:
            cut = names
        return [BAD] * cut + [GOOD] * (n - cut)
    # a paragraph before, furniture or the end behind
    tail = n
    while tail > 0 and named(run[tail - 1]):
        tail -= 1
    if n - tail >= LIST_LEAST and not any(YEAR.search(x) for x in run[tail:]):
        return [GOOD] * n
    return [GOOD] * tail + [BAD if after == BAD else GOOD] * (n - tail)


def site_of(host: str | None) -> str | None:
    """A site's name as its host spells it."""
    return re.sub(r"\s+\d+$", "", host.rsplit(".", 1)[0].replace("-", " ")).lower() if host and "." in host else None


def find_furniture(pages: DataFrame, key: list[str], text: str, title: str, site: str) -> DataFrame:
    """(key, line_no, line) of every non-blank line that is not main body, each once.

    Null, empty and blank texts give no rows; a page of one line is main body unless the line itself is decided;
    pages delivered twice come out once; pages without a site are one site; very long pages are read whole; an empty
    table gives no rows; other columns are not read. Link texts are counted over all pages of a site; a page then meets
    its site's list only, which is one row of bounded length, so a site with a third of all pages is no obstacle.
    """
    src, shared = _with_labels(pages, key, text, title, site)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(shared)
        for pdf in batches:
            rows = []
            for k, t, h, u, own in zip(zip(*[pdf[c] for c in key]), pdf["__t"], pdf["__h"], pdf["__u"], pdf["__own"]):
                lines = t.split("\n")
                rows += [(*k, i, lines[i]) for i in furniture(t, h, site_of(u), known(u, own))]
            yield pd.DataFrame(rows, columns=[*key, "line_no", "line"]).astype({**{c: pdf[c].dtype for c in key}, "line_no": "int64", "line": "object"})

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in key)
    return src.filter(F.trim("__t") != "").mapInPandas(run, f"{kinds}, line_no long, line string").distinct()


def _with_labels(pages: DataFrame, key: list[str], text: str, title: str, site: str) -> tuple[DataFrame, Labels]:
    src = pages.select(*key, F.col(text).alias("__t"), F.col(title).alias("__h"), F.col(site).alias("__u"))
    texts, shared = link_texts(src, "__u", "__t")
    own = texts.groupBy("site").agg(F.collect_list("h").alias("__own"))
    return src.join(own, F.coalesce("__u", F.lit("")) == F.col("site"), "left"), shared


class _Known:
    """Link texts that a page of a site meets, made once for each site in a task."""

    def __init__(self, shared: Labels):
        self.shared, self.sites = shared, {}

    def __call__(self, site: str | None, own) -> Labels:
        if own is None:
            return self.shared
        if site not in self.sites:
            if len(self.sites) >= 1_000:
                self.sites.clear()
            self.sites[site] = self.shared.union(own)
        return self.sites[site]


def main_body(pages: DataFrame, key: list[str], text: str, title: str, site: str, out: str = "body") -> DataFrame:
    """(key, body): each page's text without its furniture; null stays null, a page of furniture only becomes empty."""
    src, shared = _with_labels(pages, key, text, title, site)

    def body(known: _Known, t: str | None, h: str | None, u: str | None, own) -> str | None:
        if t is None:
            return None
        drop = set(furniture(t, h, site_of(u), known(u, own)))
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop).strip("\n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(shared)
        for pdf in batches:
            yield pd.DataFrame({**{c: pdf[c] for c in key}, out: [body(known, *x) for x in zip(pdf["__t"], pdf["__h"], pdf["__u"], pdf["__own"])]})

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in key)
    return src.mapInPandas(run, f"{kinds}, `{out}` string").distinct()
