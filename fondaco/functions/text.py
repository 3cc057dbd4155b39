"""Column functions over text: tokens, normal forms, dates, scripts, languages, windows. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their plain ones, for both engines alike.
ACCENTS = ("àáâãäåèéêëìíîïòóôõöùúûüçñýÿšž", "aaaaaaeeeeiiiiooooouuuucnyysz")

# Marker words of four languages; a text shorter than MARKED_CHARS has none.
MARKERS = {
    "it": "di che del della delle nato nata morto morta brigata partigiano partigiana comune documento archivio resistenza".split(),
    "de": "der die das und geb geboren gestorben archiv akten krieg stand ort deutsch unterlagen".split(),
    "en": "the and born died record archive service war place date document casualty".split(),
    "fr": "le la les des est ne mort nee archive document guerre lieu date resistance".split(),
}
MARKED_CHARS = 40

# What a wrong decoding leaves in a text.
MOJIBAKE = ["\ufffd", "\u00c3", "\u00c2", "\u00e2\u20ac"]


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain(c: str | Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(_c(c)), *ACCENTS)


def latin_tokens(c: str | Column, least: int = 3) -> Column:
    """Plain alphanumeric tokens of at least so many characters."""
    return F.regexp_extract_all(plain(c), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))


def word_tokens(c: str | Column) -> Column:
    """Lower-case tokens of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def label_form(c: str | Column) -> Column:
    """A label as it is compared: lower case, hyphens as blanks, no punctuation, single blanks."""
    s = F.regexp_replace(F.lower(_c(c)), r"[-\x{2010}-\x{2015}]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N} ]", ""), r" +", " "))


def order_free(c: str | Column) -> Column:
    """Tokens of a label in alphabetical order."""
    return F.array_join(F.array_sort(F.split(label_form(c), " ")), " ")


def slug(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(plain(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def first_year(c: str | Column) -> Column:
    """The first year from 1800 to 2099 as a string, null if there is none."""
    return F.nullif(F.regexp_extract(_c(c), r"(?:^|[^0-9])(1[89][0-9]{2}|20[0-9]{2})(?:[^0-9]|$)", 1), F.lit(""))


MONTHS_IT = "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split()


def iso_date(c: str | Column) -> Column:
    """An ISO, numeric or Italian written date as YYYY-MM-DD; null where none stands (days aren't checked)."""
    t = F.lower(_c(c))
    part = lambda p, g: F.regexp_extract(t, p, g)
    iso, num, word = r"(1[89][0-9]{2}|20[0-9]{2})-([0-9]{2})-([0-9]{2})", r"([0-9]{1,2})[./]([0-9]{1,2})[./](1[89][0-9]{2}|20[0-9]{2})", r"([0-9]{1,2}) (" + "|".join(MONTHS_IT) + r") (1[89][0-9]{2}|20[0-9]{2})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS_IT]), part(word, 2)).cast("string")
    two = lambda x: F.lpad(x, 2, "0")
    return (
        F.when(part(iso, 0) != "", part(iso, 0))
        .when(part(num, 0) != "", F.concat_ws("-", part(num, 3), two(part(num, 2)), two(part(num, 1))))
        .when(part(word, 0) != "", F.concat_ws("-", part(word, 3), two(month), two(part(word, 1))))
    )


def script(c: str | Column) -> Column:
    """cyrillic, latin or none, by the larger number of letters."""
    cyr = F.length(F.regexp_replace(_c(c), r"[^\p{IsCyrillic}]", ""))
    lat = F.length(F.regexp_replace(_c(c), r"[^A-Za-zÀ-ÿ]", ""))
    return F.when((cyr == 0) & (lat == 0), "none").when(cyr > lat, "cyrillic").otherwise("latin")


def window_around(c: str | Column, start: Column, width: int = 80) -> Column:
    """The characters around a position (from 1), blanks squeezed."""
    at = F.greatest(start - width, F.lit(1))
    return F.trim(F.regexp_replace(F.substr(_c(c), at, F.lit(2 * width)), r"\s+", " "))


def marker_score(tokens: str | Column, language: str) -> Column:
    """Occurrences of a language's markers among tokens plus twice the number of different ones."""
    marks = F.array(*[F.lit(m) for m in MARKERS[language]])
    return F.size(F.filter(_c(tokens), lambda t: F.array_contains(marks, t))) + 2 * F.size(F.array_intersect(marks, _c(tokens)))


def mojibake(c: str | Column) -> Column:
    """Whether a text holds a mark of a wrong decoding."""
    out = F.lit(False)
    for m in MOJIBAKE:
        out = out | _c(c).contains(m)
    return out


def levenshtein_within(a: str | Column, b: str | Column, most: int) -> Column:
    """Edit distance where it is at most ``most``, else null (the bounded form stops early)."""
    x = F.levenshtein(_c(a), _c(b), most)
    return F.when(x >= 0, x)


def strip_tags(c: str | Column) -> Column:
    """Text of an HTML fragment: no scripts, styles or tags, common entities resolved, blanks squeezed."""
    s = F.regexp_replace(_c(c), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def page_title(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(_c(c), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def page_heading(c: str | Column) -> Column:
    return strip_tags(F.regexp_extract(_c(c), r"(?is)<h1[^>]*>(.*?)</h1>", 1))


def page_links(c: str | Column) -> Column:
    """array<struct<url, label>> of the anchors with a target, in order."""
    anchors = F.regexp_extract_all(_c(c), F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    return F.transform(anchors, lambda a: F.struct(F.regexp_extract(a, r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1).alias("url"), strip_tags(a).alias("label")))


def hidden_inputs(c: str | Column) -> Column:
    """map<name, value> of hidden form fields (the last of equal names)."""
    tags = F.regexp_extract_all(_c(c), F.lit(r"(?is)<input\b[^>]*type\s*=\s*[\"']hidden[\"'][^>]*>"), F.lit(0))
    pair = F.transform(tags, lambda t: F.struct(F.regexp_extract(t, r"(?is)\bname\s*=\s*[\"']([^\"']*)[\"']", 1).alias("k"), F.regexp_extract(t, r"(?is)\bvalue\s*=\s*[\"']([^\"']*)[\"']", 1).alias("v")))
    keys = F.array_distinct(F.transform(pair, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pair, lambda p: p["k"] == k), -1)["v"]))


# Latin groups of letters and letters in Cyrillic.
CYRILLIC = {
    "shch": "щ", "sch": "щ", "yo": "ё", "yu": "ю", "ya": "я", "ye": "е", "zh": "ж", "kh": "х", "ts": "ц", "ch": "ч", "sh": "ш", "ju": "ю", "ja": "я", "ij": "ий",
    "a": "а", "b": "б", "c": "к", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "й", "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "q": "к", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в", "x": "кс", "y": "ы", "z": "з",
}


def to_cyrillic(c: str | Column) -> Column:
    """Latin text in Cyrillic letters, from left to right: at each place the longest group of letters that the table has."""
    groups = "|".join(sorted(CYRILLIC, key=lambda x: (-len(x), x)))
    table = F.map_from_arrays(F.array(*map(F.lit, CYRILLIC)), F.array(*map(F.lit, CYRILLIC.values())))
    pieces = F.regexp_extract_all(F.lower(_c(c)), F.lit(f"(?s)(?:{groups})|."), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(table, p), p)), "")


def drop_repeated_lead(c: str | Column, most: int = 8) -> Column:
    """A text without the second copy of a phrase of up to ``most`` words that begins it twice (the longest such phrase)."""
    return F.regexp_replace(_c(c), rf"^(\S+(?: \S+){{0,{most - 1}}}) \1(?= |$)", "$1")


def dates_compatible(a: str | Column, b: str | Column) -> Column:
    """Whether two partial dates (YYYY, YYYY-MM, YYYY-MM-DD) may be one day; unknown ones are compatible with all."""
    x, y = F.coalesce(_c(a), F.lit("")), F.coalesce(_c(b), F.lit(""))
    return x.startswith(y) | y.startswith(x)
