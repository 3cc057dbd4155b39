"""Template residue, filler, error pages and script notices: exemplar retrieval and TF-IDF containment over windows.

Labelled exemplars of residue stand in an inverted index (a bounded list, sent to the executors). Every document is cut
in passage windows; a window's tokens retrieve exemplars, and the window is residue when the share of its TF-IDF weight
that retrieved exemplars cover reaches a threshold. A document is excluded when its residue windows make up most
of its content, headings, menu lines and record numbers set aside; or when a window contains an exemplar of an unfilled
template field: there the containment is the exemplar's, the share of its weight (runs of two and three tokens, marks and
names in their order) that the window has. An exemplar's name may be open (any name counts), where only the marks tell.

Token weights are idf over all windows of the corpus, counted exactly for the exemplars' vocabulary in a first
pass (partial counts per partition, summed); a token no exemplar has weighs as the middle one of them, so
the weights don't need the corpus's whole vocabulary.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Exemplars at most, as they are sent to every executor.
MAX_EXEMPLARS = 20_000
#: Tokens of a window at most.
WINDOW = 40
#: Share of a window's weight that exemplars must cover; share of the content that residue windows must make up.
CONTAINMENT, COVERAGE = 0.6, 0.5

# Messages of servers, script notices and filler as such systems print them, by language.
MESSAGES = {
    "error": """
404 Not Found. The requested address was not found on this server.
403 Forbidden. You don't have permission to open this page.
500 Internal Server Error. The server encountered an internal error and was unable to complete your request.
502 Bad Gateway.
503 Service Temporarily Unavailable (gateway 1)
504 Gateway Time-out.
Document could not be retrieved (timeout after 1 ms).
Access denied. Too many requests from your network. Reference ID 1.
Database error: could not execute query. Contact the webmaster quoting 1.
Traceback (most recent call last): File "view.py", line 1, in load; KeyError: 'body'
Warning: mysql_connect(): too many connections in /srv/app/view.php on line 1
Exception in thread "main" java.lang.NullPointerException at View.render(View.java:1)
Page not found. The page you requested does not exist or has been moved.
Your session has expired. Please log in again to view the document.
The site is down for maintenance. We will be back online shortly.
An error has occurred. Please try again later.
Errore 500 - Errore interno del server. Riprovare più tardi o scrivere all'amministratore.
Errore 404 - Pagina non trovata. La scheda richiesta non esiste oppure è stata spostata.
Pagina non trovata.
Accesso negato. Non si dispone dei permessi per aprire la pagina.
Troppe richieste in poco tempo: l'accesso dal vostro indirizzo è sospeso per 1 minuti.
Sessione scaduta. Effettuare nuovamente l'accesso per consultare il documento.
Il servizio è in manutenzione. Torneremo online al più presto.
Si è verificato un errore. Riprovare più tardi.
Es ist ein Fehler aufgetreten. Bitte laden Sie die Seite neu.
Die angeforderte Seite wurde nicht gefunden. Fehlercode 1.
Zugriff verweigert. Sie haben keine Berechtigung.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Der Dienst ist wegen Wartungsarbeiten vorübergehend nicht verfügbar.
Erreur : la page demandée est introuvable ou a été supprimée.
Erreur interne du serveur. Veuillez réessayer plus tard.
Accès refusé. Votre session a expiré, veuillez vous reconnecter.
Ошибка 502. Сервер временно недоступен, повторите запрос позже.
Страница не найдена. Доступ запрещён.
""",
    "script": """
Please enable JavaScript to view this page.
You need to have scripts turned on to run this app.
Your browser does not support scripting or it is switched off.
Loading… If nothing appears, switch on active scripting and reload.
Checking your browser before opening the archive. This takes a few seconds.
This site requires JavaScript and cookies to work.
Per visualizzare la scheda è necessario attivare JavaScript nel browser.
Il visualizzatore richiede script attivi; il vostro browser li ha disabilitati.
Caricamento in corso… attivare gli script per proseguire.
Bitte aktivieren Sie JavaScript, um den Katalog zu nutzen.
Dieser Viewer läuft nur mit eingeschaltetem Scripting.
Ce site nécessite JavaScript pour fonctionner.
Veuillez activer les scripts dans votre navigateur.
Для просмотра страницы включите JavaScript.
""",
    "filler": """
Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
Ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure
Averis tecla vix solvit domit amentia mordet sidut fulgo quas maris sulio ipsum pondere nostrem colligo valorem iunda algor tantum lorem perenta prestum velar rubrum neque crepat
Testo di prova.
Placeholder paragraph one. Placeholder paragraph two.
Contenuto segnaposto, non pubblicare.
Inserire qui il testo della scheda. Minimo tre paragrafi.
Descrizione in preparazione.
Qui andrà la descrizione del fondo.
Dummy record for layout check only.
This is sample text. Replace this sample text with your own content.
Blindtext Blindtext: hier steht später der eigentliche Inhalt.
Texte de remplissage, à remplacer avant publication.
Тестовая запись. Здесь будет текст описания.
asdf asdf asdf qwerty qwerty prova prova 123
xxx xxx xxx xxx xxx xxx
titolo titolo titolo sottotitolo sottotitolo corpo corpo corpo
""",
}
# Names of fields in templates of records and letters, by language.
FIELD_NAMES = "nome cognome data luogo reparto name surname date place unit title vorname nachname datum ort einheit anrede nom prenom date lieu unite unité titre имя фамилия дата место часть звание".split()
# Forms of an unfilled field, x standing for its name; any name counts inside these.
STRONG = ["{{ x }}", "{{ record.x }}", "{% if x %}", "{0:x}", "${x}", "[[x]]", "<%= x %>", "@@x@@", "__x__", "((x))", "«Campo_x»", "[TBD: x]", "[x DA INSERIRE]", "[insert x here]", "[hier x einsetzen]", "<inserire x>", "XXXX_x", "TODO x"]
#: Forms that only a known field's name makes a field: marks of editors look alike.
WEAK = ["{x}", "<x>", "[x]", "%x%", "$x$", "#x#", "&lt;x&gt;"]

#: Share of a field exemplar's weight that a window must hold.
FIELD_CONTAINED = 0.8
#: An open name in an exemplar.
ANY = "*"
#: Tokens around fields: marks, and names with the dots and underscores inside them.
FIELD_TOKEN = re.compile(r"\{\{|\}\}|\{%|%\}|\$\{|<%=|%>|\[\[|\]\]|\(\(|\)\)|@@|__+|&lt;|&gt;|«campo(?=_)|»|\bx{3,}(?=_)|[\[\]{}<>%$#:]|[^\W\d_](?:[^\W_]|[._](?=[^\W_]))*|\d+|[^\w\s]")
_MARK = re.compile(r"[{}\[\]<>%$#]|@@|«campo|__|\(\(|&lt;|\bx{3,}_|\btodo\b", re.I)


def _split(form: str) -> list[str]:
    return re.split(r"\bx\b|(?<=_)x(?=_|»|$)", form)


def field_runs(found: list[str], opened: bool = False) -> list[tuple[str, ...]]:
    """Runs of two and three tokens; with ``opened`` also those in which names stand as open ones."""
    out = []
    for n in (2, 3):
        for k in range(len(found) - n + 1):
            run = tuple(found[k : k + n])
            out.append(run)
            if opened:
                out += [(*run[:i], ANY, *run[i + 1 :]) for i, t in enumerate(run) if t[0].isalpha()]
    return out


def field_exemplars() -> list[tuple[str, ...]]:
    """Tokens of every field exemplar: strong forms with an open name, the others with each known name."""
    closed = ("TODO x", "__x__")
    forms = [(f, [ANY]) for f in STRONG if f not in closed] + [(f, FIELD_NAMES) for f in WEAK] + [(f, FIELD_NAMES) for f in closed]
    word = "slotname"
    return list(dict.fromkeys(tuple(n if t == word else t for t in FIELD_TOKEN.findall(word.join(_split(f)).lower())) for f, names in forms for n in names))


TOKEN = re.compile(r"\{\{|\}\}|\{%|%\}|\$\{|<%=|%>|\[\[|\]\]|\(\(|\)\)|@@|__+|&lt;|&gt;|«campo|\bx{4,}(?=_)|[\[\]{}<>%$#]|[^\W_]+")
MENU = re.compile(r"\S\s*(?:[|·•»›]|\s/)\s*\S.*(?:[|·•»›]|\s/)\s*\S")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=\S)")
LISTED = re.compile(r"^\d+[.)]\s")
RECORD = re.compile(r"^\W*(?:id|nr|n|no|ref|reference id|rif)?[\s.:#°]*[0-9a-f-]*\d[0-9a-f-]*\W*$", re.I)


def tokens(text: str) -> list[str]:
    """Lower-case words and the marks that templates put around fields; digits count as one token."""
    return [t if t.isalpha() else "0" if t.isdigit() else re.sub(r"\d+", "", t) or "0" for t in TOKEN.findall(text.lower())]


def aside(line: str) -> bool:
    """Whether a line is no content: a menu, a record number, or a heading (short, without a full stop, no list entry)."""
    return bool(MENU.search(line) or RECORD.match(line) or (len(line) <= 80 and line[-1] not in ".!?…;:" and len(line.split()) <= 9 and not LISTED.match(line)))


def windows(text: str) -> list[tuple[str, str]]:
    """(passage, its line): sentences of each line, long ones in pieces."""
    out = []
    for line in text.split("\n"):
        line = line.strip()
        if line:
            for s in _SENTENCE.split(line) if len(line) > 60 or _SENTENCE.search(line) else (line,):
                words = s.split()
                if len(words) <= WINDOW:
                    out.append((" ".join(words), line))
                else:
                    out += [(" ".join(words[k : k + WINDOW]), line) for k in range(0, len(words), WINDOW)]
    return out


def exemplars() -> list[tuple[str, str]]:
    """(label, text): the labelled residue that is looked for."""
    said = [(label, line.strip()) for label, block in MESSAGES.items() for line in block.strip().split("\n")]
    alone = [(label, s) for label, line in said for s in re.split(r"(?<=[.!?…])\s+", line)]
    return list(dict.fromkeys(said + alone))


class Residue:
    """The inverted index over exemplars with corpus weights."""

    def __init__(self, listed: list[tuple[str, str]], df: dict[str, int], n_windows: int, fields: list[tuple[str, ...]] | None = None):
        self.sets = [(label, frozenset(tokens(text))) for label, text in listed]
        vocab = {t for _, s in self.sets for t in s}
        n = max(n_windows, 1)
        self.idf = {t: math.log(1 + n / (1 + df.get(t, 0))) for t in vocab}
        self.other = median(self.idf.values()) if self.idf else 1.0
        self.weight = [sum(self.idf[t] for t in s) for _, s in self.sets]
        self.index: dict[str, list[int]] = {}
        for k, (_, s) in enumerate(self.sets):
            for t in s:
                self.index.setdefault(t, []).append(k)
        # fields: runs of tokens, weighed by their tokens; those with a mark retrieve
        self.fields = [frozenset(field_runs(list(f))) for f in (field_exemplars() if fields is None else fields)]
        weigh = lambda run: sum(math.log(1 + n / (1 + df.get(t, 0))) if t != ANY else self.other for t in run)
        self.run_weight = {run: weigh(run) for f in self.fields for run in f}
        self.field_weight = [sum(self.run_weight[run] for run in f) for f in self.fields]
        self.field_index: dict[tuple[str, ...], list[int]] = {}
        for k, f in enumerate(self.fields):
            for run in f:
                self.field_index.setdefault(run, []).append(k)
        self.longest = max((len(f) for f in self.fields), default=0)

    def field(self, text: str) -> float:
        """The greatest containment of a field exemplar in a passage."""
        if not _MARK.search(text):
            return 0.0
        share: Counter = Counter()
        for run in set(field_runs(FIELD_TOKEN.findall(text.lower()), opened=True)):
            for k in self.field_index.get(run, ()):
                share[k] += self.run_weight[run]
        return max((v / self.field_weight[k] for k, v in share.items()), default=0.0)

    def window(self, text: str) -> tuple[str, float]:
        """(label, containment) of the best reading of a window; label '' if nothing is retrieved."""
        w = set(tokens(text))
        if not w:
            return "", 0.0
        if not any(t.isalpha() for t in w):
            return "", 0.0
        known = [t for t in w if t in self.index]
        whole = sum(self.idf.get(t, self.other) for t in w)
        if not known or sum(self.idf[t] for t in known) < CONTAINMENT * whole:
            return "", 0.0  # even all exemplars together can't cover enough
        share: dict[int, float] = Counter()
        for t in known:
            for k in self.index[t]:
                share[k] += self.idf[t]
        best = max(share, key=lambda k: (share[k], -k))
        # exemplars that stand wholly in the window cover it together (several notices in one passage)
        joint = set().union(*(self.sets[k][1] for k in share if share[k] >= 0.8 * self.weight[k]), self.sets[best][1])
        covered = sum(self.idf[t] for t in known if t in joint) / whole
        return self.sets[best][0], covered

    def document(self, text: str | None) -> tuple[str, float]:
        """(label, coverage): label '' unless the document is to be left out."""
        if text is None or not text.strip():
            return "", 0.0
        hit, others, first = 0, [], Counter()
        if _MARK.search(text):
            for line in text.split("\n"):
                words = line.split() if _MARK.search(line) else []
                for k in range(0, len(words), WINDOW):  # windows overlap by the longest exemplar
                    contained = self.field(" ".join(words[k : k + WINDOW + self.longest]))
                    if contained >= FIELD_CONTAINED:
                        return "template", contained
        for passage, line in windows(text):
            label, covered = self.window(passage)
            if label and covered >= CONTAINMENT:
                hit += len(passage)
                first[label] += len(passage)
            else:
                others.append((passage, line))
        rest = sum(len(p) for p, line in others if not aside(line)) if hit else 0
        coverage = hit / (hit + rest) if hit else 0.0
        return (max(sorted(first), key=lambda k: first[k]) if coverage >= COVERAGE else ""), coverage


def find_residue(docs: DataFrame, key: str, text: str, listed: list[tuple[str, str]] | None = None) -> DataFrame:
    """(key, label, coverage) of the documents to leave out.

    Null, empty and blank texts are no case; very long texts are read whole, window by window; repeated texts each come
    out under their own key; an empty table or an empty exemplar list finds nothing; other columns are not read.
    """
    listed = exemplars() if listed is None else listed
    if len(listed) > MAX_EXEMPLARS:
        raise ValueError(f"more than {MAX_EXEMPLARS} exemplars")
    marks = {t for f in field_exemplars() for t in f if t != ANY}
    vocab = {t for _, x in listed for t in tokens(x)} | marks
    src = docs.select(F.col(key), F.col(text).alias("__text")).filter(F.trim("__text") != "")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df: Counter = Counter()
        for pdf in batches:
            for t in pdf["__text"]:
                for passage, _ in windows(t):
                    df[""] += 1
                    seen = set(tokens(passage))
                    df.update((seen.union(FIELD_TOKEN.findall(passage.lower())) if _MARK.search(passage) else seen) & vocab)
        yield pd.DataFrame(list(df.items()), columns=["token", "n"])

    counts = {r.token: r.n for r in src.select("__text").mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}  # at most the exemplars' vocabulary
    total = counts.pop("", 0)
    kind = docs.schema[key].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Residue(listed, counts, total)
        for pdf in batches:
            got = [(k, *r.document(t)) for k, t in zip(pdf[key], pdf["__text"])]
            yield pd.DataFrame([g for g in got if g[1]], columns=[key, "label", "coverage"]).astype({key: pdf[key].dtype})

    return src.mapInPandas(find, f"`{key}` {kind}, label string, coverage double")
