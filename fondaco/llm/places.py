"""Mapping free-entered values to a canonical list: a BK-tree under a true edit metric.

Each distinct written value is reduced to a comparison form (kind of place + core name), the cores of the reference
list stand in a BK-tree under the Levenshtein metric, and the triangle inequality prunes the search without losing an
entry within the threshold. The tree is broadcast while the list is bounded; a longer list is cut into shards, every
shard answers for itself, and the winners of all shards are merged.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

#: Longest reference list that is broadcast as one tree; beyond it the list is sharded.
TREE_ROWS = 20_000
#: Kinds of place as they are written out (longest spelling first), by canonical kind.
KINDS = {
    "santa maria": ("santa maria", "s.ta maria", "sta maria", "s. maria", "s.maria", "s maria", "s. m.", "s.m.", "s.m"),
    "borgo": ("borgo", "b.go", "bgo", "b.go."),
    "castel": ("castello", "castel", "cast.", "c.tel", "ctel"),
    "ca": ("casa", "ca'", "cà", "ca’", "ca`", "ca"),
    "monte": ("monte", "m.te", "mte", "m."),
    "pieve": ("pieve", "p.ve", "pve"),
    "ponte": ("ponte", "p.te", "pte"),
    "rocca": ("rocca", "r.ca", "rca"),
    "san": ("san", "s."),
}
#: Words before a name that say where, not what.
LEAD = re.compile(r"^(?:nei pressi di|nelle vicinanze di|vicino a|dintorni di|comune di|località|localita|frazione|presso|loc\.|fraz\.|com\.|near|bei|près de|pres de|at|in|à|a|zu)\s+(?=\S)")
TAIL = re.compile(r"(?:\s*\((?:fraz|loc|com)\.?\)|\s*[-,]\s*italia|\s+(?:bassa|alta|vecchia|nuova|superiore|inferiore))\s*$")
PROVINCE = re.compile(r"\s*\(\s*([a-z]{2})\s*\)\s*$")
PROVINCE_NAME = re.compile(r"[\s,]+prov(?:\.|incia)?\s+(?:di\s+)?([a-zà-ÿ]+)\s*$")
FOLD = str.maketrans({"0": "o", "1": "l", "5": "s", "’": "'", "`": "'", "´": "'"})
KIND_OF = {f: k for k, forms in KINDS.items() for f in forms}
_PREFIXES = sorted(((s, k) for k, forms in KINDS.items() for s in forms), key=lambda x: -len(x[0]))


def distances_from(word: str) -> Callable[[str], int]:
    """Levenshtein distance (a true metric) of other words to one: bit-parallel, the one's positions of letters are made once."""
    m = len(word)
    if not m:
        return len
    peq: dict[str, int] = {}
    for i, c in enumerate(word):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top, at = (1 << m) - 1, 1 << (m - 1), peq.get

    def distance(other: str) -> int:
        pv, mv, score = full, 0, m
        for c in other:
            eq = at(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1) | 1
            mh <<= 1
            pv = (mh | ~(xv | ph)) & full
            mv = ph & xv & full
        return score

    return distance


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance of two words."""
    return 0 if a == b else distances_from(a)(b)


def swap_distance(a: str, b: str) -> int:
    """Edits with a swap of neighbours as one: ranks what the metric search has returned."""
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            cur.append(v)
        prev2, prev = prev, cur
    return prev[-1]


class BKTree:
    """Words under the edit metric; :meth:`within` returns every word at most ``d`` away."""

    def __init__(self, words: Iterable[str] = ()):
        self.root: tuple[str, dict] | None = None
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while True:
            d = edit_distance(word, node[0])
            if d == 0:
                return
            nxt = node[1].get(d)
            if nxt is None:
                node[1][d] = (word, {})
                return
            node = nxt

    def within(self, word: str, d: int) -> list[tuple[int, str]]:
        found, todo = [], [self.root] if self.root else []
        distance = distances_from(word)
        while todo:
            w, kids = todo.pop()
            x = distance(w)
            if x <= d:
                found.append((x, w))
            for k in range(x - d, x + d + 1):
                if k in kids:
                    todo.append(kids[k])
        return sorted(found)


def _strip(value: str) -> tuple[str, str, str]:
    """The value without province, state and the like, and the province's code and name."""
    s = unicodedata.normalize("NFKC", value).lower().translate(FOLD)
    s = re.sub(r"[\s\u00ad\u200b]+", " ", s).strip(" ?!;:.\"«»")
    code = name = ""
    for _ in range(4):
        before = s
        if m := PROVINCE.search(s):
            code, s = m[1], s[: m.start()]
        elif m := PROVINCE_NAME.search(s):
            name, s = m[1], s[: m.start()]
        elif m := TAIL.search(s):
            s = s[: m.start()]
        s = s.strip(" ?!;:.,-")
        if s == before:
            break
    while (m := LEAD.match(s)) and len(s) - m.end() >= 4:
        s = s[m.end() :]
    return s, code, name


def _core(s: str) -> str:
    return re.sub(r"[^\w]+", "", s).replace("j", "i")


def _after(rest: str) -> str:
    return re.sub(r"^di\b[\s'-]*", "", re.sub(r"^[\s'.-]*", "", rest))


def place_forms(value: str) -> tuple[list[tuple[str, str]], str, str]:
    """Readings (kind, core) of a value as written, then province code and name; empty where it has none.

    A value has several readings where a kind of place may be part of the name or misspelt itself.
    """
    s, code, name = _strip(value)
    a, comma, b = s.partition(",")
    if comma:  # the kind of place put behind the name
        b = re.sub(r"\s+di$", "", b.strip())
        if b in KIND_OF or b + "." in KIND_OF:
            s = f"{b if b in KIND_OF else b + '.'} {a.strip()}"
    s = s.replace("-", " ")
    forms = [("", _core(s))]
    for p, k in _PREFIXES:
        if s.startswith(p) and len(s) > len(p):
            rest = s[len(p) :]
            free = rest[0] in " '." or p[-1] in ".'"
            if free or (p == k and len(p) >= 3):
                core = _core(_after(rest))
                if len(core) >= (3 if free else 5):
                    forms = ([] if free else forms) + [(k, core)]
                    break
    if forms[0][0] == "" and len(forms) == 1 and " " in s:  # a misspelt kind
        for k in KINDS:
            n = k.count(" ") + 1
            words = s.split(" ")
            head, rest = " ".join(words[:n]), " ".join(words[n:])
            if rest and len(head) >= 3 and swap_distance(head, k) == 1:
                forms.append((k, _core(_after(rest))))
    return [f for f in dict.fromkeys(forms) if f[1]], code, name


class PlaceIndex:
    """The entries of one shard: a BK-tree over cores, and the entries that each core may mean."""

    def __init__(self, entries: Iterable[tuple[str, str, str, str]]):
        """entries: (entry id, label, province code, province name); an entry may come with several labels."""
        self.by_core: dict[str, set[tuple[str, str, str, str]]] = {}
        for eid, label, code, name in entries:
            if label is None or not label.strip():
                continue
            kind, core = place_forms(label)[0][0] if place_forms(label)[0] else ("", "")
            if core:
                self.by_core.setdefault(core, set()).add((eid, kind, (code or "").lower(), (name or "").lower()))
        self.tree = BKTree(sorted(self.by_core))
        self._found: dict[tuple, tuple[int, list[str]] | None] = {}

    def best(self, value: str) -> tuple[int, list[str]] | None:
        """The lowest rank of any entry within the threshold and the ids that have it (sorted)."""
        forms, code, name = place_forms(value)
        reading = (*forms, code, name)  # spellings of one reading are searched once
        if reading not in self._found:
            if len(self._found) >= 100_000:
                self._found.clear()
            self._found[reading] = self._best(forms, code, name)
        return self._found[reading]

    def _best(self, forms: list[tuple[str, str]], code: str, name: str) -> tuple[int, list[str]] | None:
        found: dict[int, set[str]] = {}
        for kind, core in forms:
            hits = [(0, core)] if core in self.by_core else []
            if not any(k == kind for _, k, _, _ in self.by_core.get(core, ())):
                hits = self.tree.within(core, edits(core) + 1)  # a swap counts two here
            for _, w in hits:
                d = swap_distance(core, w)
                if d > edits(core):
                    continue
                for eid, k, c, n in self.by_core[w]:
                    if k != kind and kind and k:
                        continue
                    wrong = bool((code and c and code != c) or (name and n and name != n))
                    found.setdefault(4 * d + 2 * wrong + (k != kind), set()).add(eid)
        if not found:
            return None
        rank = min(found)
        return rank, sorted(found[rank])


def edits(core: str) -> int:
    """Edits (swaps counted once) by which a core of this length may differ from its entry."""
    return 0 if len(core) < 5 else 1 if len(core) < 16 else 2


_SCHEMA = "value string, rank int, ties long, first string"
#: Values of a group that meets one shard, about.
GROUP_VALUES = 100_000


def map_values(values: DataFrame, entries: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Map each distinct ``value`` to its entry: columns value, entry_id ('' if unmatched or undecided), rank (null then).

    ``values`` has a column ``value``; ``entries`` has entry_id, label, code, province (one row per label).
    Rank is 4 x edits + 2 if the province contradicts + 1 if the kind of place is left out; entries that tie at the lowest
    rank leave the value undecided. Null and blank values get no row; repeated values one row; an empty list leaves
    every value unmatched; very long values have no entry near them and are cheap, as their length prunes the tree.

    The list is sent to the executors only while it has at most ``tree_rows`` labels. A longer one is cut in shards of that size; each
    shard's tree is built once and kept as a serialised row, groups of about GROUP_VALUES values meet every shard, and the
    shards' winners are merged. Both ways give the same rows.
    """
    vals = values.select("value").filter(F.trim("value") != "").distinct()
    ents = entries.select("entry_id", "label", "code", "province").filter(F.trim("label") != "")
    n = ents.count()
    if n <= tree_rows:
        rows = [tuple(r) for r in ents.collect()]

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = PlaceIndex(rows)
            for pdf in batches:
                yield _answers(index, pdf["value"])

        best = spread(vals, "value").mapInPandas(look, _SCHEMA)
    else:
        vals = cut(vals)
        shards, groups = -(-n // tree_rows), max(1, -(-vals.count() // GROUP_VALUES))

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            index = PlaceIndex(pdf[["entry_id", "label", "code", "province"]].itertuples(index=False, name=None))
            return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps((index.by_core, index.tree.root))]})

        # all labels of an entry are in one shard
        trees = cut(ents.withColumn("shard", F.pmod(F.xxhash64("entry_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, tree binary"))
        left = vals.withColumn("g", F.pmod(F.xxhash64("value"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        right = trees.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

        def both(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            index = PlaceIndex(())
            if len(r):
                index.by_core, index.tree.root = pickle.loads(r["tree"].iloc[0])
            return _answers(index, l["value"])

        won = left.groupBy("shard", "g").cogroup(right.groupBy("shard", "g")).applyInPandas(both, _SCHEMA)
        low = won.groupBy("value").agg(F.min("rank").alias("low"))
        best = won.join(low, "value").filter(F.col("rank").eqNullSafe(F.col("low"))).groupBy("value", "rank").agg(F.sum("ties").alias("ties"), F.min("first").alias("first"))
    one = F.col("ties") == 1
    return best.select("value", F.when(one, F.col("first")).otherwise("").alias("entry_id"), F.when(one, F.col("rank")).alias("rank"))


def _answers(index: PlaceIndex, values: pd.Series) -> pd.DataFrame:
    out = []
    for v in values:
        b = index.best(v)
        out.append((v, b[0] if b else None, len(b[1]) if b else 0, b[1][0] if b else None))
    return pd.DataFrame(out, columns=["value", "rank", "ties", "first"]).astype({"rank": "Int32", "ties": "int64", "first": "object"})
