"""Names and dates as people type them: readings of persons, organisations and days.

A name is read as (kind, initial, surname, given name): titles, battle names, fathers' and husbands' names and middle names
are set aside, nicknames and cut given names are led back to the name they stand for, a surname's particle is
glued to it. Everything here works on one string at a time and knows nothing of other records.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .places import swap_distance

# Given names, and the short and foreign forms used for them.
GIVEN = frozenset(
    """
adelmo adele aldo alfredo angela angelo anna antonia antonio armando arturo attilio bianca bruno carlo carla caterina cesare clelia dino dirce domenico elena emilio enrico ermanno ernesto
ettore ferdinando filippo francesca francesco gaetano giacomo gina gino giorgio giovanna giovanni giulia giulio giuseppe giuseppina grazia guido ida irma ivo libero lorenzo lucia luigi luisa
maria mario marco marta matteo michele nicolò norma olga olindo ondina oreste paola paolo pietro primo quinto raffaele renato rina roberto rodolfo rosa salvatore secondo sergio silvio stefano teresa
tina tommaso ugo umberto valerio vincenzo virgilio vittoria vittorio walter zelinda zeno
adolf anton bernhard emil erich ernst franz friedrich fritz georg günther hans heinrich hermann johann johannes josef jürgen karl klaus konrad kurt ludwig martin matthias otto paul peter rudolf walther werner wilhelm
aleksandr aleksej andrej boris dmitrij fëdor grigorij igor ivan jurij konstantin mikhail nikolaj oleg pavel petr semën sergej stepan vasilij viktor vladimir
""".split()
)
NICK = {
    short: full
    for full, shorts in {
        "adelmo": "delmo", "aleksandr": "alessandro alexander sascha sasha aleksander alexandr", "alfredo": "fredo", "andrej": "andrei andrey andrea", "angelo": "angiolino angiolo", "antonio": "toni tonino tonio nino",
        "arturo": "turo", "attilio": "tilio", "bianca": "bianchina", "carlo": "carletto", "caterina": "nina rina cate", "cesare": "cesarino", "dmitrij": "mitja dmitri dmitry dimitri", "domenico": "mimmo menico mingo", "elena": "lena",
        "enrico": "rico", "ernesto": "tino ernestino", "ettore": "ettorino", "francesca": "cesca checca", "friedrich": "fritz", "fëdor": "fedor fjodor fyodor feodor teodoro", "gaetano": "tano", "georg": "joerg jörg jorg", "giacomo": "jacopo mino giacomino",
        "giovanni": "nanni vanni gianni", "giuseppe": "beppe peppino pino peppe beppino", "grigorij": "grisha grischa gregorio grigori grigory", "guido": "guidino", "günther": "guenther gunter gunther guenter günter", "hans": "hansi", "heinrich": "heinz heini", "ivan": "vanja vanya iwan",
        "johannes": "johann hannes", "josef": "sepp joseph", "jurij": "yuri juri jura", "jürgen": "juergen jurgen", "karl": "karli carl", "lorenzo": "renzo", "ludwig": "lutz", "luigi": "gigi gino luigino", "maria": "mariuccia", "mario": "mariolino", "matthias": "mathias hias", "michele": "lino", "mikhail": "misha mischa michail mihail",
        "nicolò": "cola nicolo nicola", "nikolaj": "kolja nikolai nikolay kolya", "paolo": "paolino", "pavel": "pasha pawel pascha", "pietro": "pierino piero", "raffaele": "lele raffaello", "renato": "renatino", "rodolfo": "dolfo", "rosa": "rosina", "rudolf": "rudi rudolph",
        "salvatore": "toto totò turi", "sergej": "sergey sergei serjoscha", "stepan": "stefan stjopa", "teresa": "resi teresina", "tommaso": "maso masino", "umberto": "berto", "vasilij": "vasily wassili vasja wassilij vasili", "vincenzo": "cencio enzo", "vladimir": "volodja wladimir vova", "walther": "walter",
        "wilhelm": "willi willy", "zelinda": "linda",
    }.items()
    for short in shorts.split()
    if short not in GIVEN or short in ("fritz", "nina", "rina", "gino", "johann")
}
#: Names that two languages share are one for comparison.
SAME = {"walther": "walter", "nicola": "nicolò"}
RANKS = frozenset("cap serg ten sold magg gen col cpl mllo maresciallo sergente capitano tenente soldato partigiano partigiana patriota don dott sig sigra signor signora gefr uffz obgefr oblt lt hptm fw pvt sgt cpt capt lieutenant soldat frère avv prof ing conte padre suor m.llo sig.ra cap.le magg. caporale".split())
PARTICLES = frozenset("di de del della dello dalla dal d da van von zu la lo".split())
FOLD = str.maketrans({"0": "o", "1": "l", "5": "s", "’": "'", "`": "'", "´": "'", "‘": "'"})

# Spellings of kinds of organisation; the rest of the name is their place or leader.
ORGANISATIONS = [
    ("cln", r"^(?:cln|c\.\s?l\.\s?n\.?|comit(?:ato|\.)\s+(?:di\s+)?liberazione\s+naz(?:ionale|\.)?)"),
    ("afc", r"^(?:a\.?\s?f\.?\s?c\.?|ass(?:ociazione|oc\.|\.)?\s+fam(?:iglie|\.)?\s+(?:dei\s+)?caduti|famiglie\s+(?:dei\s+)?caduti)(?=\W)"),
    ("brigata", r"^(?:brigata\s+d['’]assalto|brigata|brg\.?|bgt\.?|brig\.)(?=\W)"),
    ("feldkommando", r"^(?:feld[\s-]?kommando|feldkdo\.?|fk\.?|feldkomm\.)(?=\W)"),
    ("distretto", r"^(?:distretto\s+militare|distr(?:etto|\.)?\s*mil(?:itare|\.re|\.)?|d\.?\s?m\.)(?=\W|$)"),
]
_ORG = [(k, re.compile(p, re.I)) for k, p in ORGANISATIONS]
_BEHIND = re.compile(r"^(.*\S)\s*\((associazione|feldkommando|brigata|distretto militare|cln|distretto)\)\s*$", re.I)
_BEHIND_KIND = {"associazione": "afc", "feldkommando": "feldkommando", "brigata": "brigata", "distretto militare": "distretto", "distretto": "distretto", "cln": "cln"}


def fold(s: str) -> str:
    """Lower case without accents and look-alike digits."""
    s = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", s).lower().translate(FOLD))
    return "".join(c for c in s if not unicodedata.combining(c))


_GIVEN = {fold(g): fold(SAME.get(g, g)) for g in GIVEN} | {fold(k): fold(SAME.get(v, v)) for k, v in NICK.items()}
_FULL = sorted({fold(SAME.get(g, g)) for g in GIVEN})


@lru_cache(maxsize=50_000)
def given_of(token: str, dotted: bool) -> tuple[str, str] | None:
    """(canonical given name or '', initial) a token may stand for; None if it is none.

    A single letter has only an initial. A cut name of 3 letters or more stands for the one name it begins; one that
    begins several comes back as 'adel*'.
    """
    t = fold(token)
    if len(t) == 1:
        return ("", t) if t.isalpha() else None
    if t in _GIVEN:
        g = _GIVEN[t]
        return g, g[0]
    if dotted and len(t) >= 3:
        starts = [g for g in _FULL if g.startswith(t)]
        if len(starts) == 1:
            return starts[0], starts[0][0]
        if starts:
            return t + "*", t[0]
        near = [g for g in _FULL if swap_distance(t, g[: len(t)]) == 1 and g[0] == t[0]]
        return (near[0], t[0]) if len(near) == 1 else ("", t[0])
    if not dotted and 3 <= len(t) <= 4:
        starts = [g for g in _FULL if g.startswith(t)]
        if len(starts) == 1:
            return starts[0], starts[0][0]
        if starts and len(t) == 4:
            return t + "*", t[0]
    if len(t) >= 4:
        near = {_GIVEN[g] for g in _GIVEN if abs(len(g) - len(t)) <= 1 and len(g) >= 4 and swap_distance(t, g) == 1}
        if len(near) == 1:
            g = near.pop()
            return g, g[0]
    return None


def _short(token: str) -> tuple[str, str] | None:
    """Written contractions of given names such as "Dom.co"."""
    m = re.fullmatch(r"([^\W\d_]+)\.([^\W\d_]{1,3})", token)
    if not m:
        return None
    a, b = fold(m[1]), fold(m[2])
    fits = [g for g in _FULL if g.startswith(a) and g.endswith(b)]
    return (fits[0], fits[0][0]) if len(fits) == 1 else ("", a[0])


@lru_cache(maxsize=100_000)
def parse_name(raw: str) -> tuple[str, str, str, str] | None:
    """(kind, initial, surname, given): kind is 'person' or one of the organisations; None if nothing can be read.

    ``given`` is '' when only an initial stands there, 'adel*' for a cut one, '~enico' for one not in the lists, and initial is '' when the name is a surname alone. For
    organisations the surname is what tells them apart and the rest is empty.
    """
    s = unicodedata.normalize("NFKC", raw).replace("­", "").translate(str.maketrans({"’": "'", "`": "'", "´": "'"})).strip(" ,;")
    s = re.sub(r"\s+", " ", s)
    first, comma_at, second = s.partition(",")
    if comma_at and any(p.fullmatch(second.strip() + " ") or p.fullmatch(second.strip()) or (m := p.match(second.strip() + " ")) and m.end() >= len(second.strip()) for _, p in _ORG):
        s = f"{second.strip()} {first.strip()}"  # the kind of organisation put behind
    behind = _BEHIND.match(s)
    tail_kind = ""
    body = s
    if behind:
        body, tail_kind = behind[1], _BEHIND_KIND[behind[2].lower()]
    for kind, pattern in _ORG:
        if m := pattern.match(body):
            rest = fold(re.sub(r"^\W*(?:di|del|della)\s+", "", body[m.end() :].strip(" -–:,«»\"'"), flags=re.I))
            core = re.sub(r"[^a-z]", "", re.sub(r"\bdi\b", "", rest))
            return (kind, "#" + kind, core, "") if len(core) >= 3 else None
    if tail_kind:
        core = re.sub(r"[^a-z]", "", fold(re.sub(r"\bdi\b", "", body)))
        return (tail_kind, "#" + tail_kind, core, "") if len(core) >= 3 else None
    s = re.sub(r"\([^)]*\)|\"[^\"]*\"|«[^»]*»|“[^”]*”", " ", s)
    s = re.sub(r"\b(?:detto|detta|alias|genannt|dit|dite)\s+[\w'-]+", " ", s, flags=re.I)
    comma = s.find(",")
    words: list[tuple[str, bool]] = []
    found = re.findall(r"[^\W\d_]\.(?:[^\W\d_]\.)+|[^\W\d_]+\.[^\W\d_]{1,3}\b|[\w'-]+\.?", s)
    ranks = [fold(w).replace(".", "") in RANKS for w in found]
    if len(found) - sum(ranks) < 2:  # "Serg." beside a surname alone is a given name
        ranks = [False] * len(found)
    for w, rank in zip(found, ranks):
        if not rank:
            words.append((w.rstrip(".") if not re.search(r"\.\w", w) else w, w.endswith(".")))
    # fathers and husbands
    low = [fold(w) for w, _ in words]
    for k in range(2, len(words)):
        if low[k] in ("fu", "in", "ved") or (low[k] == "di" and k + 1 < len(words) and given_of(words[k + 1][0], words[k + 1][1]) and k + 2 >= len(words)):
            words, low = words[:k], low[:k]
            break
    # glue particles to what follows
    joined: list[tuple[str, bool]] = []
    k = 0
    while k < len(words):
        w, dot = words[k]
        if low[k] in PARTICLES and k + 1 < len(words) and not dot and len(low[k]) > 1:
            n = k + 1
            while n + 1 < len(words) and low[n] in PARTICLES:
                n += 1
            joined.append(("".join(x for x, _ in words[k:n]) + words[n][0], words[n][1]))
            k = n + 1
        else:
            joined.append((w, dot))
            k += 1
    if not joined:
        return None
    read = [_short(w) or given_of(w, dot) for w, dot in joined]
    plain = [re.sub(r"[^a-z]", "", fold(w)) for w, _ in joined]
    if len(joined) == 1:
        return ("person", "", plain[0], "") if len(plain[0]) >= 3 else None
    free = [k for k in range(len(joined)) if read[k] is None and len(plain[k]) >= 3]
    if not free:  # every word may be a given name: the last one is the surname, or the first before a comma
        k = 0 if comma > 0 else max(range(len(joined)), key=lambda i: (len(plain[i]) > 1, i))
        free = [k]
    last = max(free, key=lambda i: (len(plain[i]), i))
    rest = [k for k in range(len(joined)) if k != last]
    # the given name: a whole one rather than an initial, and "Maria" only where nothing else stands
    known = [k for k in rest if read[k]]
    strong = [k for k in known if read[k][0] and plain[k] != "maria"] or [k for k in known if not read[k][0] and known and not any(read[i][0] for i in known)] or known
    if strong:
        g, i = read[strong[0]]
        return "person", i, plain[last], g
    # an unknown given name beside the surname
    g = plain[rest[0]] if rest else ""
    return "person", g[:1], plain[last], "~" + g if len(g) > 2 else ""


# Month names in five languages; a cut name of three letters or more counts too.
MONTH_NAMES = [
    "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "january february march april may june july august september october november december",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "jänner februar maerz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь",
]


@lru_cache(maxsize=1_000)
def month_of(word: str) -> int:
    """The month that a word names in full or begins, 0 for none."""
    for names in MONTH_NAMES:
        for k, name in enumerate(names.split(), 1):
            if word == name or (len(word) >= 3 and name.startswith(word)):
                return k
    return 0


ROMAN = {m: i for i, m in enumerate("i ii iii iv v vi vii viii ix x xi xii".split(), 1)}
_ISO = re.compile(r"\b(1[89]\d\d)-(\d{1,2})-(\d{1,2})\b")
_DMY = re.compile(r"\b(\d{1,2})[./-](\d{1,2}|[ivx]{1,4})[./-](1[89]\d\d)\b")
_WORDS = re.compile(r"(?:\b(\d{1,2})(?:er|st|nd|rd|th|º|°)?\.?\s+(?:de\s+|of\s+)?)?([a-zà-ÿа-яё]{3,12})\.?,?\s+(1[89]\d\d)\b")
_YEAR = re.compile(r"\b(1[89]\d\d)\b")


def parse_dates(text: str | None) -> list[tuple[int, str, int]]:
    """(start, date, end) of every date in a text: 'YYYY', 'YYYY-MM' or 'YYYY-MM-DD'."""
    if not text:
        return []
    s = unicodedata.normalize("NFKC", text).lower()
    out: list[tuple[int, str, int]] = []
    taken = [False] * len(s)

    def put(m: re.Match, date: str) -> None:
        if not any(taken[m.start() : m.end()]):
            out.append((m.start(), date, m.end()))
            for k in range(m.start(), m.end()):
                taken[k] = True

    for m in _ISO.finditer(s):
        put(m, f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}")
    for m in _DMY.finditer(s):
        month = ROMAN.get(m[2]) or (int(m[2]) if m[2].isdigit() else 0)
        if 1 <= month <= 12:
            put(m, f"{m[3]}-{month:02d}-{int(m[1]):02d}")
    for m in _WORDS.finditer(s):
        month = month_of(m[2])
        if month:
            put(m, f"{m[3]}-{month:02d}" + (f"-{int(m[1]):02d}" if m[1] else ""))
    for m in _YEAR.finditer(s):
        put(m, m[1])
    return sorted(out)


def parse_date(text: str | None) -> str:
    """The first date of a text, '' if it has none."""
    d = parse_dates(text)
    return d[0][1] if d else ""


def dates_agree(a: str, b: str) -> bool:
    """Whether two dates may be the same day: one begins the other. Unknown ones agree with all."""
    return a.startswith(b) or b.startswith(a)
