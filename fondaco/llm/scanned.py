"""Text of scanned pages: lines labelled by a linear-chain model, broken words joined, misread words found and put right.

1. Labelling: each page's lines are a sequence with the states body, head and number (blank lines are breaks). A line's
   score for a state is a weighted sum of layout features (shape of a number, indent against the body's margin,
   distance to the page's edge, length, capitals, ends and starts of sentences, how often lines worded alike stand at the
   edge of other pages), a transition has its own weight, and the best path is decoded (Viterbi). Running heads and
   numbers inside a transcript of several pages are found the same way, as they interrupt a sentence. No list of titles is
   used: which wordings head pages is counted over all pages of single scans. Weights are fitted to the pages themselves:
   from START, decoding and a logistic fit (with START as its prior) take turns over a bounded sample of records.
2. Broken words: a body line that ends in a hyphen goes on in the next body line, behind heads and numbers. Whether the
   hyphen is the word's own is decided by how often the corpus has the joined and the hyphenated word in mid-line.
3. Misread characters: words of the whole corpus are counted; words that fall together when characters that scanners confuse are
   one class are compared, and the rare one is a misreading of a far more frequent one if every difference is a known
   confusion. Words meet through that class key only, never as all pairs.
4. Reassembly: lines of a paragraph are joined, heads and numbers left out, broken words closed, misread words replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, forget, spread

# a numeral with digits, some read as letters; one read as letters throughout; a Roman one
_NUMERAL = r"(?:(?=[lIiOoSsBzZ|]*[0-9])[0-9lIiOoSsBzZ|]{1,5}|[lIO|]{2,4}|(?=[ivxlcIVXLC])(?:[cC]{0,3}(?:[xX][cC]|[xX][lL]|[lL]?[xX]{0,3})(?:[iI][xX]|[iI][vV]|[vV]?[iI]{0,3})))"
NUMBER = re.compile(
    rf"^\W*(?:(?:p|pp|pag|pagina|page|seite|s|bl|blatt|c|cc|carta|f|fol|foglio|стр|с|л)\b\W{{0,3}})?{_NUMERAL}(?:\s*[vr])?(?:\s*/\s*{_NUMERAL})?\W*$|^\W*(?:p|page|seite|c|стр|pag)\W{{0,2}}\s*(?=\S*[0-9]){_NUMERAL}[vr]?\W*$",
    re.I,
)
HYPHENS = "-‐¬­="
_HYPHEN_ENDS = tuple(HYPHENS)
#: Entries of contents, lists and totals; a running head beside a page number.
LISTED = re.compile(r"\.{3,}\s*\d|^\d+[.)]\s|^(?:totale|total|summe|итог|итого)\b", re.I)
PAGED = re.compile(rf"^\W*\d{{1,4}}\s{{2,}}\S|\s[–—]\s+{_NUMERAL}\W*$")
_BROKEN = re.compile(rf"([^\W\d_]+)[{HYPHENS}]\s*$")
_WORD = re.compile(r"[^\W_ſ]*[\wſ]+(?:[-‐'’][\wſ]+)*")
_END = re.compile(r"[.!?…:»\"”)]$")

STATES = ("body", "head", "number")
#: Features of a head against body, and of a number; a line that isn't shaped like a number is none.
HEAD = ("bias", "edge", "short", "caps", "goes_on", "off", "margin", "sentence", "list", "paged", "seen", "usual", "runs_on")
NUM = ("bias", "edge", "goes_on", "off", "margin", "year", "in_sentence", "letter")
#: Weights before the fit, and the fit's prior; transitions by (from, to) in the order of STATES.
START = {
    "head": np.array([-7.5, 1.5, 1.0, 0.8, 2.0, 5.0, -2.5, -5.0, -8.0, 1.5, 6.0, 10.0, -2.0]),
    "number": np.array([7.0, 2.0, 3.0, 5.0, -2.5, -9.0, -6.0, -6.0]),
    "moves": np.array([[0.0, -0.5, -0.5], [0.0, -4.0, 0.8], [0.0, 0.8, -4.0]]),
}
#: Records to which the weights are fitted at most (the first by hash), rounds of the fit, strength of its prior.
FIT_RECORDS, FIT_ROUNDS, PRIOR = 2_000, 3, 1.0
#: Share of a wording's pages at whose edge it stands, for a wording seen and a usual one; pages that must have it.
SEEN, USUAL, PAGES = 0.45, 0.65, 3
#: Characters at either end of a misread wording that are as they should be.
NEAR = 5
#: What the share of a first word alone counts, as it says less than a longer beginning.
ONE_WORD = 0.65


_BEFORE_NUMBER = frozenset("a ad al alle di del dal il nel nr nummer numero box folder file mappe karton band busta cartella fascicolo furono circa etwa rund about some in und e et de le la au vom am seit lists shows omits bears bore bore on by around около в из указано записано марта".split())


def line_features(lines: list[str], offsets: list[float | None] | None = None, seen: dict[int, float] | None = None) -> tuple[list[int], list[tuple[tuple, tuple | None]]]:
    """Numbers of the lines that aren't blank, and each one's features (head, number; None if it has no number's shape).

    offsets: a line's left edge, where the layout is known; seen: share of pages with its wording at their edge, by line.
    """
    seen = seen or {}
    idx = [k for k, x in enumerate(lines) if x and x.strip()]
    n = len(idx)
    if not n:
        return idx, []
    text = [lines[k].strip() for k in idx]
    width = median(sorted(len(x) for x in text)[-max(1, n // 2) :])
    left = None
    if offsets:
        known = sorted(offsets[k] for k in idx if offsets[k] is not None and len(lines[k].strip()) >= 0.6 * width)
        left = median(known) if known else None
    shaped = [bool(NUMBER.match(x)) and not LISTED.search(x) for x in text]
    outer = lambda j: shaped[j] or seen.get(idx[j], 0.0) >= SEEN
    ends = [bool(_END.search(x)) for x in text]
    out = []
    for j, x in enumerate(text):
        edge = j == 0 or j == n - 1 or (j == 1 and outer(0)) or (j == n - 2 and outer(n - 1))
        open_before = j > 0 and not ends[j - 1]
        goes_on = open_before and j + 1 < n and text[j + 1][:1].islower()
        runs_on = not goes_on and not ends[j] and j + 1 < n and text[j + 1][:1].islower()
        off = offsets[idx[j]] - left if left is not None and offsets[idx[j]] is not None else None
        away, margin = (off > 8, off <= 8) if off is not None else (False, False)
        num = None
        if shaped[j]:
            year = off is None and not goes_on and re.fullmatch(r"1[89]\d\d\W*", x)
            inside = off is None and not year and open_before and not goes_on and re.fullmatch(r"\d+\.", x) and _words(text[j - 1])[-1:] and _words(text[j - 1])[-1] in _BEFORE_NUMBER
            num = (1, edge, goes_on, away, margin, bool(year), bool(inside), not edge and bool(re.fullmatch(r"\W*[a-z]\W*", x, re.I)))
        share = seen.get(idx[j], 0.0)
        sentence = x[:1].islower() or x.endswith(_HYPHEN_ENDS) or (ends[j] and share < USUAL)
        head = (1, edge, len(x) < 0.8 * width or len(x) < 45, x.isupper() and len(x) > 3, goes_on, away, margin, sentence, bool(LISTED.search(x)), bool(PAGED.search(x)), SEEN <= share < USUAL, share >= USUAL, runs_on)
        out.append((head, num))
    return idx, out


def decode(features: list[tuple[tuple, tuple | None]], weights: dict) -> list[int]:
    """The best path of states over the lines of a record (Viterbi)."""
    wh, wn, t = weights["head"].tolist(), weights["number"].tolist(), weights["moves"].tolist()
    best, back = None, []
    for head, num in features:
        own = (0.0, -50.0, sum(w for w, f in zip(wn, num) if f)) if num else (0.0, sum(w for w, f in zip(wh, head) if f), -50.0)
        if best is None:
            best = own
            back.append((0, 0, 0))
            continue
        now, ways = [], []
        for s in (0, 1, 2):
            a, b, c = best[0] + t[0][s], best[1] + t[1][s], best[2] + t[2][s]
            p = 0 if a >= b and a >= c else 1 if b >= c else 2
            now.append((a, b, c)[p] + own[s])
            ways.append(p)
        best = now
        back.append(ways)
    if best is None:
        return []
    s = max((0, 1, 2), key=lambda q: best[q])
    path = []
    for ways in reversed(back):
        path.append(s)
        s = ways[s]
    return path[::-1]


def label_lines(lines: list[str], offsets: list[float | None] | None = None, seen: dict[int, float] | None = None, weights: dict = START) -> list[str]:
    """body, head, number or break for each line."""
    idx, features = line_features(lines, offsets, seen)
    out = ["break"] * len(lines)
    for k, s in zip(idx, decode(features, weights)):
        out[k] = STATES[s]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Weights of a logistic fit whose Gaussian prior stands at ``prior``; Newton's steps, halved while they don't help."""
    w, loss = prior.copy(), lambda v: float(np.logaddexp(0, x @ v).sum() - y @ (x @ v) + ((v - prior) ** 2).sum() / (2 * PRIOR**2))
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / PRIOR**2, x.T @ (y - p) - (w - prior) / PRIOR**2)
        size = 1.0
        while size > 1e-3 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if size * np.abs(step).max() < 1e-4:
            break
    return w


def fit_weights(records: list[list[tuple[tuple, tuple | None]]]) -> dict:
    """Weights fitted to records' features without labels: decoding and a conditional fit take turns, from START on."""
    weights, records = START, [r for r in records if r]
    if not records:
        return weights
    heads = np.array([h for r in records for h, _ in r], dtype=float)
    shaped = np.array([n is not None for r in records for _, n in r])
    nums = np.array([n for r in records for _, n in r if n is not None], dtype=float).reshape(-1, len(NUM))
    for _ in range(FIT_ROUNDS):
        paths = [decode(r, weights) for r in records]
        y = np.array([s for p in paths for s in p])
        moves, totals = np.ones((3, 3)), np.zeros(3)
        for p in paths:
            for a, b in zip(p, p[1:]):
                moves[a, b] += 1
        totals = moves.sum(axis=0) / moves.sum()
        gain = np.log(moves / moves.sum(axis=1, keepdims=True) / totals)
        new = {
            "head": _logistic(heads[~shaped], (y[~shaped] == 1).astype(float), START["head"]),
            "number": _logistic(nums, (y[shaped] == 2).astype(float), START["number"]) if len(nums) else START["number"],
            "moves": np.clip(gain - gain[:, :1], -4.0, 2.0),
        }
        if all(np.allclose(new[k], weights[k], atol=1e-3) for k in new):
            break
        weights = new
    return weights


def _words(line: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(line.replace("‐", "-").replace("’", "'"))]


def read_lines(lines: list[str | None], offsets: list[float | None] | None = None, seen: dict[int, float] | None = None, weights: dict = START) -> list[tuple]:
    """(line_no, label, words, left, right, hard, next_no) of each line that isn't blank.

    left and right are the parts of a word that the line's end splits (right '' at the end of the record), hard says
    that its mark is never part of a spelling; both parts are left out of words.
    """
    text = [x or "" for x in lines]
    labels = label_lines(text, offsets, seen, weights)
    body = [k for k, m in enumerate(labels) if m == "body"]
    after = {a: b for a, b in zip(body, body[1:])}
    words = {k: _words(text[k]) for k in body}
    split: dict[int, tuple] = {}
    for k in body:
        m = _BROKEN.search(text[k].rstrip())
        if not m or len(m[1]) < 1:
            continue
        nxt = after.get(k, -1)
        first = re.match(r"\s*([^\W\d_]+)", text[nxt]) if nxt >= 0 else None
        if nxt >= 0 and not first:
            continue
        lead = re.search(rf"((?:[^\W_]+[-'’‐])*[^\W\d_]+)[{HYPHENS}]\s*$", text[k].rstrip())[1].lower()
        split[k] = (lead, first[1].lower() if first else "", text[k].rstrip()[-1] in "¬­", nxt)
    for k, (_, right, _, nxt) in split.items():
        words[k] = words[k][:-1]
        if right:
            words[nxt] = words[nxt][1:]
    return [(k, labels[k], words.get(k, []), *(split.get(k) or ("", "", False, -1))) for k in range(len(text)) if labels[k] != "break"]


_LINES = "src string, rec_key string, line_no long, label string, words array<string>, left string, right string, hard boolean, next_no long"


def wordings(records: DataFrame) -> DataFrame:
    """(src, rec_key, line_no, edge, keys) of the lines that may head a page: no sentence's end, no small letter first.

    keys are the line's wording without its number: whole, its first one to three words, its length with its last two words (of two words the last).
    edge tells whether it is one of the first or last two lines that aren't blank.
    """
    text = F.transform("lines", lambda x: F.trim(F.coalesce(x["text"], F.lit(""))))
    at = F.filter(F.transform("t", lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    r = records.select("src", "rec_key", text.alias("t")).withColumn("at", at)
    outer = F.array_union(F.slice("at", 1, 2), F.slice("at", F.greatest(F.size("at") - 1, F.lit(1)), 2))
    r = r.select("src", "rec_key", outer.alias("outer"), F.posexplode("t").alias("line_no", "x"))
    r = r.filter(F.col("x").rlike(rf"^[^\p{{Ll}}]") & ~F.col("x").rlike(rf"(?:[.!?…:;,]|[{HYPHENS}])$|^\d+[.)]\s|\.{{3,}}|^[^\p{{L}}\p{{N}}]*\p{{L}}{{0,6}}[^\p{{L}}\p{{N}}]*\S*\d\S*$"))
    numeral = r"(?:[0-9lIiOoSsBzZ|]*[0-9][0-9lIiOoSsBzZ|]*|[ivxlcIVXLC1|]+)"
    bare = F.regexp_replace("x", rf"^[^\p{{L}}\p{{N}}]*{numeral}[^\p{{L}}\p{{N}}]*\s{{2,}}|\s+[–—-]+\s+{numeral}[^\p{{L}}\p{{N}}]*$|,\s*{numeral}\.?$|\s{{2,}}{numeral}[^\p{{L}}\p{{N}}]*$", "")
    w = F.filter(F.split(F.translate(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "), "015ё", "olsе"), " "), lambda v: v != "")
    r = r.select("src", "rec_key", F.col("line_no").cast("long").alias("line_no"), F.array_contains("outer", F.col("line_no")).alias("edge"), w.alias("w")).filter(F.size("w") > 0)
    n, part = F.size("w"), lambda k, a, m: F.concat(F.lit(k), F.concat_ws(" ", F.slice("w", a, m)))
    keys = F.array(
        F.concat(F.lit("f:"), F.concat_ws(" ", "w")), *[F.when(n > m, part("p:", 1, m)) for m in (1, 2, 3)],
        F.when(n > 2, F.concat(F.lit("s:"), n, part(":", F.greatest(n - 1, F.lit(1)), 2))), F.when(n == 2, part("e:", n, 1)),
    )
    return r.select("src", "rec_key", "line_no", "edge", F.filter(keys, lambda k: k.isNotNull()).alias("keys"))


def sure_share(e: Column, n: Column) -> Column:
    """A share less what few pages leave uncertain (three quarters of 1 / sqrt n)."""
    n = F.greatest(n, F.lit(1))
    return e / n - 0.75 / F.sqrt(n)


def head_lines(records: DataFrame, pages: list[str] | None = None) -> DataFrame:
    """(src, rec_key, line_no, share) of lines whose wording stands at the edge of other pages; others have no row.

    The share is that of the pages of ``pages`` (sources whose records are single pages; all when None) with this wording on
    which it stands at the edge, the line's own page apart. A wording one edit from a usual one shares its count.
    """
    made = [w := cut(wordings(records))]
    single = F.col("src").isin(pages) if pages else F.lit(True)
    by_key = w.select("src", "rec_key", single.alias("single"), "edge", F.explode("keys").alias("k")).filter(F.col("single") | F.col("k").startswith("f:"))
    per_page = by_key.groupBy("k", "src", "rec_key", "single").agg(F.max(F.col("edge").cast("long")).alias("e"))
    page = F.col("single").cast("long")
    counts = cut(per_page.groupBy("k").agg(F.sum(page).alias("n"), F.sum(page * F.col("e")).alias("e"), F.count(F.lit(1)).alias("m")).filter(F.col("m") >= PAGES))
    made.append(counts)
    # where several records repeat a whole wording, none of them a single page, its first word alone says nothing
    furniture = counts.filter("n = 0").select(F.col("k").alias("whole"))
    counts = counts.filter(F.col("n") >= PAGES)
    each = w.select("src", "rec_key", "line_no", single.cast("long").alias("own"), (single & F.col("edge")).cast("long").alias("own_edge"), F.col("keys")[0].alias("whole"), F.explode("keys").alias("k"))
    alone = F.col("k").rlike("^p:[^ ]+$")
    each = each.filter(~alone).unionByName(each.filter(alone).join(furniture, "whole", "left_anti"))
    share = sure_share(F.col("e") - F.col("own_edge"), F.col("n") - F.col("own")) * F.when(alone, ONE_WORD).otherwise(1.0)
    exact = each.join(counts, "k").filter(F.col("n") - F.col("own") >= PAGES - 1).withColumn("share", share).filter(F.col("share") >= SEEN)
    exact = cut(exact.groupBy("src", "rec_key", "line_no").agg(F.max("share").alias("share")))
    # misread wordings: one edit from a usual one. One edit leaves the first or the last NEAR characters as they are, so wordings meet by these
    fuzzy = F.col("k").rlike("^(?:f:|p:.* )") & (F.length("k") >= 2 + 2 * NEAR)
    usual = counts.filter(fuzzy & (sure_share(F.col("e"), F.col("n")) >= SEEN)).select(F.col("k").alias("u"), sure_share(F.col("e"), F.col("n")).alias("share"))
    left = w.join(exact.filter(F.col("share") >= USUAL), ["src", "rec_key", "line_no"], "left_anti").select("src", "rec_key", "line_no", F.explode("keys").alias("k")).filter(fuzzy)
    ends = lambda c: F.array(F.concat(F.lit("<"), F.substring(c, 1, 2 + NEAR)), F.concat(F.lit(">"), F.substring(c, 1, 2), F.substring(c, -NEAR, NEAR)))
    met = left.select("k").distinct().withColumn("end", F.explode(ends("k"))).join(usual.withColumn("end", F.explode(ends("u"))), "end")
    letters = lambda c: F.array_sort(F.split(c, ""))
    edits = F.levenshtein("k", "u", 2)
    one = (edits == 1) | ((edits == 2) & (F.length("k") == F.length("u")) & (letters("k") == letters("u")))  # or two letters in each other's place
    near = met.filter((F.abs(F.length("k") - F.length("u")) <= 1) & one).groupBy("k").agg(F.max("share").alias("share"))
    out = cut(exact.unionByName(left.join(near, "k").select("src", "rec_key", "line_no", "share")).groupBy("src", "rec_key", "line_no").agg(F.max("share").alias("share")))
    forget(*made, exact)
    return out


def _offsets(lines: list) -> list[float | None] | None:
    xs = [x["x0"] for x in lines]
    return xs if any(v is not None for v in xs) else None


def label_records(records: DataFrame, weights: dict = START) -> DataFrame:
    """Labelled lines of records (src, rec_key, lines array<struct<text, x0>>, seen map<line_no, share>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for src, key, lines, seen in zip(pdf["src"], pdf["rec_key"], pdf["lines"], pdf["seen"]):
                out += [(src, key, *r) for r in read_lines([x["text"] for x in lines], _offsets(lines), dict(seen) if seen is not None else None, weights)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _LINES.split(", ")])

    return records.select("src", "rec_key", "lines", "seen").filter("lines is not null").mapInPandas(run, _LINES)


def fitted(records: DataFrame, rows: int = FIT_RECORDS) -> dict:
    """Weights fitted to at most ``rows`` records, the first by the hash of their keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lines, seen in zip(pdf["lines"], pdf["seen"]):
                f = line_features([x["text"] or "" for x in lines], _offsets(lines), dict(seen) if seen is not None else None)[1]
                out.append(("".join("".join("01"[bool(v)] for v in (*h, *(n or ()))) + ";" for h, n in f),))
            yield pd.DataFrame(out, columns=["f"])

    first = records.filter("lines is not null").orderBy(F.xxhash64("src", "rec_key"), "src", "rec_key").limit(rows)
    got = [r.f for r in first.repartition(records.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "f string").collect()]
    back = lambda x: (tuple(map(int, x[: len(HEAD)])), tuple(map(int, x[len(HEAD) :])) or None)
    return fit_weights([[back(x) for x in f.split(";") if x] for f in sorted(got)])


# How scanners misread characters (true, read); the first of a class stands for it in the key.
CONFUSED = [
    ("e", "c"), ("o", "0"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("s", "5"), ("s", "ſ"), ("f", "ſ"), ("t", "f"), ("g", "q"), ("b", "6"), ("h", "b"), ("v", "y"), ("g", "9"), ("z", "2"), ("o", "c"), ("u", "n"), ("n", "u"),
    ("е", "c"), ("е", "с"), ("о", "0"), ("и", "н"), ("п", "л"), ("ш", "щ"), ("в", "8"), ("з", "3"), ("б", "6"), ("п", "н"), ("о", "с"), ("ц", "п"), ("т", "г"),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("w", "vv"), ("u", "ii"), ("ri", "n"), ("h", "li"), ("nn", "rm"), ("ni", "m"), ("in", "m"),
]


# The classes of the key, each by its first member.
_CLASSES = ["eco0", "i1l", "ts5ſf", "gq9", "bh6", "vy", "nu", "z2", "есо", "инплц", "шщ", "в8", "з3", "тг"]
_FROM = "".join(c[1:] for c in _CLASSES)
_TO = "".join(c[0] * (len(c) - 1) for c in _CLASSES)


def skeleton(c):
    """The key under which words that differ by confusions only fall together."""
    c = F.regexp_replace(c, "rn|ni|in|nn|rm", "m")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "cl", "d"), "vv", "w"), "ii", "u")
    return F.translate(c, _FROM, _TO)


def confusion(word: str, true: str) -> bool:
    """Whether ``word`` is ``true`` with one or two characters misread in known ways, not at its beginning unless by a sign."""
    if word[:1] != true[:1] and word[:1].isalpha() and word[:1] != "ſ":
        return False
    if len(word) < 4 and word.isalpha():
        return False

    def walk(i: int, j: int, left: int) -> bool:
        while i < len(word) and j < len(true) and word[i] == true[j]:
            # a confusion may start inside an equal run, so longer readings are tried too
            if left and any(true.startswith(t, j) and word.startswith(r, i) and walk(i + len(r), j + len(t), left - 1) for t, r in CONFUSED if len(t) + len(r) > 2):
                return True
            i, j = i + 1, j + 1
        if i == len(word) and j == len(true):
            return left < 2
        return left > 0 and any(true.startswith(t, j) and word.startswith(r, i) and walk(i + len(r), j + len(t), left - 1) for t, r in CONFUSED)

    return walk(0, 0, 2)


@F.pandas_udf(T.BooleanType())
def _confused(word: pd.Series, true: pd.Series) -> pd.Series:
    return pd.Series([confusion(w, t) for w, t in zip(word, true)], dtype=bool)


#: A word with a letter among digits or a digit among letters; leaf numbers and ordinals are none.
MIXED = r"(?=.*\p{N})(?=.*[\p{L}])^(?!\p{N}+[vr]$)(?!\p{N}+(?:er|st|nd|rd|th|re|ère|bis)$)[\p{L}\p{N}ſ]+$"
#: How often the true word must stand for each misreading, and at least.
TIMES, LEAST = 4, 3


def misread_words(counts: DataFrame) -> DataFrame:
    """(word, intended) of misread words from (word, n): the most frequent word that explains each, null where none does."""
    c = cut(counts.filter(F.length("word") >= 3).withColumn("k", skeleton(F.col("word"))))
    known = c.filter(F.col("n") >= LEAST).select("k", F.col("word").alias("intended"), F.col("n").alias("m"))
    pairs = c.join(known, "k").filter((F.col("word") != F.col("intended")) & (F.col("m") >= TIMES * F.col("n")))
    # a word that is usual itself isn't a misreading, however usual the other one is
    pairs = pairs.filter(_confused("word", "intended"))
    best = pairs.groupBy("word").agg(F.max(F.struct("m", "intended")).alias("b")).select("word", F.col("b.intended").alias("intended"))
    odd = counts.filter(F.col("word").rlike(MIXED) | F.col("word").contains("ſ")).select("word")
    return best.join(odd, "word", "full_outer").select("word", "intended")


class Scanned:
    """The steps over one corpus of records; every table is made once."""

    def __init__(self, records: DataFrame, pages: list[str] | None = None):
        """records: src, rec_key, lines array<struct<text string, x0 double>>; pages: sources whose records are single pages.

        A null or empty list of lines gives no rows, a null line is a blank one; records delivered twice count once
        in every result; lines of any length are read whole; an empty table gives empty results.
        """
        self.records = records.groupBy("src", "rec_key").agg(F.min("lines").alias("lines"))
        heads = head_lines(self.records, pages)
        by_record = heads.groupBy("src", "rec_key").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "share"))).alias("seen"))  # as long as the record
        read = cut(self.records.join(by_record, ["src", "rec_key"], "left"))
        self.lines = cut(label_records(spread(read, "src", "rec_key"), fitted(read)))
        forget(heads, read)
        self.body = self.lines.filter("label = 'body'")
        inline = self.body.select(F.explode("words").alias("word"))
        joined = self.body.filter("right <> ''").select(F.concat("left", "right").alias("word"))
        self.inline = cut(inline.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
        total = self.inline.unionByName(joined.groupBy("word").agg(F.count(F.lit(1)).alias("n"))).groupBy("word").agg(F.sum("n").alias("n"))
        self.misread = cut(misread_words(total))
        self.broken = cut(self._broken())

    def _broken(self) -> DataFrame:
        """Body lines whose last word goes on: src, rec_key, line_no, next_no, left, right."""
        b = self.body.filter("left <> ''")
        n = lambda name, out: self.inline.select(F.col("word").alias(name), F.col("n").alias(out))
        b = b.withColumn("joined", F.concat("left", "right")).withColumn("hyphened", F.concat_ws("-", "left", "right"))
        b = b.join(n("joined", "nj"), "joined", "left").join(n("hyphened", "nh"), "hyphened", "left")
        # at the end of a record the rest isn't there: whether such a beginning usually stands before a hyphen
        firsts = self.inline.filter(F.col("word").contains("-")).groupBy(F.regexp_extract("word", "^([^-]+)-", 1).alias("left")).agg(F.sum("n").alias("nf"))
        b = b.join(firsts, "left", "left")
        z = lambda c: F.coalesce(F.col(c), F.lit(0))
        own = F.when(F.col("hard"), False).when(F.col("right") != "", z("nh") > z("nj")).otherwise(z("nf") > 0)
        return b.filter(~own).select("src", "rec_key", "line_no", "next_no", "left", "right")

    def found(self) -> DataFrame:
        """(src, rec_key, line_no, kind) of every damaged line, each once for each kind."""
        marked = self.lines.filter("label IN ('head', 'number')").select("src", "rec_key", "line_no", F.when(F.col("label") == "head", "running_head").otherwise("page_number").alias("kind"))
        broken = self.broken.select("src", "rec_key", "line_no", F.lit("broken_word").alias("kind"))
        inline = self.body.select("src", "rec_key", "line_no", F.explode("words").alias("word")).join(self.misread, "word", "left_semi")
        over = self.broken.filter("right <> ''").withColumn("word", F.concat("left", "right")).join(self.misread, "word")
        # of a broken word, the line that holds the misread part
        first = F.coalesce(~F.col("intended").startswith(F.col("left")), F.col("left").rlike(r"\p{N}|ſ"))
        over = over.select("src", "rec_key", F.when(first, F.col("line_no")).otherwise(F.col("next_no")).alias("line_no"))
        wrong = inline.select("src", "rec_key", "line_no").unionByName(over).withColumn("kind", F.lit("char_error"))
        return marked.unionByName(broken).unionByName(wrong).distinct()

    def texts(self) -> DataFrame:
        """(src, rec_key, text): continuous paragraphs, parted by blank lines."""
        words = self.body.select("src", "rec_key", F.explode("words").alias("word")).unionByName(self.broken.select("src", "rec_key", F.concat("left", "right").alias("word")))
        fixes = words.join(self.misread.filter(F.col("intended").isNotNull()), "word").groupBy("src", "rec_key").agg(F.collect_set(F.struct("word", "intended")).alias("fixes"))
        cuts = self.broken.groupBy("src", "rec_key").agg(F.collect_list("line_no").alias("cuts"))
        labels = self.lines.groupBy("src", "rec_key").agg(F.collect_list(F.struct("line_no", "label")).alias("labels"))  # as long as the record
        r = self.records.join(labels, ["src", "rec_key"]).join(cuts, ["src", "rec_key"], "left").join(fixes, ["src", "rec_key"], "left")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for src, key, lines, labels_, cuts_, fixes_ in zip(pdf["src"], pdf["rec_key"], pdf["lines"], pdf["labels"], pdf["cuts"], pdf["fixes"]):
                    lab = {x["line_no"]: x["label"] for x in labels_}
                    fix = {x["word"]: x["intended"] for x in fixes_} if fixes_ is not None else {}
                    out.append((src, key, paragraphs([x["text"] or "" for x in lines], lab, set(cuts_) if cuts_ is not None else set(), fix)))
                yield pd.DataFrame(out, columns=["src", "rec_key", "text"])

        return r.select("src", "rec_key", "lines", "labels", "cuts", "fixes").mapInPandas(run, "src string, rec_key string, text string")


def _like(true: str, read: str) -> str:
    return true.upper() if read.isupper() and len(read) > 1 else true[:1].upper() + true[1:] if read[:1].isupper() else true


def paragraphs(lines: list[str], labels: dict[int, str], cuts: set[int], fixes: dict[str, str]) -> str:
    """The body of a page as paragraphs."""
    width = median(sorted((len(lines[k].strip()) for k, m in labels.items() if m == "body"))[-max(1, len(labels) // 2) :] or [0])
    longest = max((len(lines[k].strip()) for k, m in labels.items() if m == "body"), default=0)
    out: list[str] = []
    now, glue, blank = "", False, False
    for k, line in enumerate(lines):
        mark = labels.get(k)
        if mark is None:
            blank = True
            continue
        if mark != "body":
            continue
        s = line.strip()
        if now and not glue and (blank and _END.search(now)):
            out.append(now)
            now = ""
        blank = False
        now = now + s if glue else f"{now} {s}".strip()
        glue = k in cuts
        if glue:
            now = re.sub(rf"[{HYPHENS}]\s*$", "", now)
        elif len(s) < 0.7 * width or len(s) < 0.4 * longest or re.search(r"\.{3,}\s*\d+$", s):
            out.append(now)
            now = ""
    if now:
        out.append(now)
    text = "\n\n".join(out)
    if fixes:
        text = _WORD.sub(lambda m: _like(fixes[m[0].lower()], m[0]) if m[0].lower() in fixes else m[0], text)
    return text
