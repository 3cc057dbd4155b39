from fondaco.llm import boilerplate as B
from fondaco.llm import residue as R
from fondaco.llm import scanned as S

PAGE = """Salta al contenuto
Roll Valli
Home · Persone · Chi siamo
Home › Persone › Mario Rossetti
Mario Rossetti
Il testimone precisa che la colonna fosse diretta al monte.
La cattura
Mario fu visto presso il mulino e non fece ritorno.
Aldo Verdi
Carlo Bianchi
Ugo Neri

Condividi su
› Pietro Gialli
Luisa Viola (1921)
Del corpo si occupò il comune fino al 1940.
Leggi anche
Dino Grigi
Questo sito usa cookie tecnici.
© 2020 Roll Valli – Tutti i diritti riservati"""


LABELS = B.label_keys("Salta al contenuto", "Roll Valli", "Home", "Persone", "Chi siamo", "Condividi su", "Leggi anche", "Questo sito usa cookie tecnici.", "© 0 Roll Valli – Tutti i diritti riservati")


def test_furniture():
    assert B.furniture(PAGE, "Mario Rossetti", "roll valli", LABELS) == [0, 1, 2, 3, 12, 13, 14, 16, 17, 18, 19]
    assert B.furniture(PAGE, None, None, LABELS) == [0, 1, 2, 3, 12, 13, 14, 16, 17, 18, 19]  # the title from the path
    assert B.furniture(None) == B.furniture("") == B.furniture("  \n ") == [] and B.furniture("Solo una riga") == []
    long_menu = "\n".join([*["Home"] * 30, "Home › Persone › Ugo Neri", "Ugo Neri", "Ugo fu visto presso il mulino e non fece ritorno."])
    assert B.furniture(long_menu, None, None, LABELS) == [*range(31)]


def test_find_furniture_and_body(spark):
    other = "Salta al contenuto\nRoll Valli\nHome · Persone · Chi siamo\nHome › Persone › Nome {0}\nNome {0}\nIl testimone numero {0} precisa che la colonna fosse diretta al monte.\nCondividi su\nLeggi anche\nQuesto sito usa cookie tecnici.\n© 2020 Roll Valli – Tutti i diritti riservati"
    words = [f"{a}{b}a" for a in "bcdfg" for b in "eiou"]
    rows = [(1, PAGE, "Mario Rossetti", "x", 9), (1, PAGE, "Mario Rossetti", "x", 9), (2, None, None, "x", 1), (3, "", "x", None, 1), (4, "Home\n" + "parola " * 20_000 + ".", None, "x", 2)]
    rows += [(10 + k, other.format(w), f"Nome {w}", "x", 0) for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "k long, t string, h string, u string, line_no int")
    got = B.find_furniture(df, ["k"], "t", "h", "u")
    lines = {}
    for r in got.collect():
        lines.setdefault(r.k, []).append(r.line_no)
    assert sorted(lines[1]) == [0, 1, 2, 3, 12, 13, 14, 16, 17, 18, 19] and lines[4] == [0] and set(lines) == {1, 4, *range(10, 30)}
    assert all(sorted(lines[k]) == [0, 1, 2, 3, 6, 7, 8, 9] for k in range(10, 30)) and got.count() == sum(map(len, lines.values()))
    body = {r.k: r.body for r in B.main_body(df, ["k"], "t", "h", "u").collect()}
    assert body[1].startswith("Mario Rossetti\nIl testimone") and body[2] is None and body[3] == ""
    assert B.find_furniture(df.limit(0), ["k"], "t", "h", "u").count() == 0


def test_residue_fields_and_marks():
    r = R.Residue(R.exemplars(), {}, 1_000)
    for t in ("nato a [[luogo]] il", "Name: {{ record.name }}.", "<inserire DATA>", "Data: ${data}", "dal %nome%, poi", "nato a __luogo__", "«Campo_nome»", "&lt;data&gt;", "TODO reparto", "((имя))", "{% if nome %}", "[TBD: x1]"):
        assert r.field(t) >= R.FIELD_CONTAINED, t
    for t in ("Mario [...] fu", "il <lacuna> monte", "{cancellato}", "[illeggibile]", "poi ___ arrivarono", "[sic]", "vide (?) la", "[c. 12r]", "100% sicuro", "<...>", "((sic transit))"):
        assert r.field(t) < R.FIELD_CONTAINED, t


def test_field_across_windows():
    r = R.Residue(R.exemplars(), {}, 1_000)
    for before in range(R.WINDOW - 4, R.WINDOW + 3):  # blanks inside a field may fall on the end of a window
        assert r.document("parola " * before + "[TBD: nome ] e poi altro")[0] == "template"


def test_residue(spark):
    long = "Il testimone precisa che la colonna passasse per il monte prima dell'alba. " * 5
    docs = [
        (1, "Please enable JavaScript to view this page."), (2, long + "Please enable JavaScript to view this page."), (3, "Home | Persone\nErrore 404 - Pagina non trovata.\nid 09ab12"), (4, "Scheda\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit sed do."),
        (5, long + " Nato a {{luogo}}."), (6, long + " [...] e <lacuna> (?)"), (7, None), (8, ""), (9, "  \n"), (10, "Scheda 4\n\nDella salma si occupò il comune prima del 1943."), (11, long * 3_000), (12, "PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE."), (13, "1. Mario Rossi, 1920\n2. Aldo Verdi, 1921\nDel corpo si occupò il comune."),
    ]
    df = spark.createDataFrame([(k, t, "z") for k, t in docs], "doc_id long, text string, label string")
    got = {r.doc_id: r.label for r in R.find_residue(df, "doc_id", "text").collect()}
    assert got == {1: "script", 3: "error", 4: "filler", 5: "template", 12: "script"}
    assert R.find_residue(df.limit(0), "doc_id", "text").count() == 0


LINES = ["BOLLETTINO STORICO", "La commissione prende atto che il registro conser-", "vato nel comune di Alto presenta cancellature e che il nord-", "ovest della zona fu colpito in piú punti. Il parroco anno-", "- 38 -", "Bolletino storico, IV", "tò il decesso di 12 civili senza indicarne i nomi.", "", "La cattura", "Il reparto lasciò il monte prima del", "1944. Totale dei nomi ignoto.", "39"]


def test_line_labels():
    assert S.label_lines(LINES, None, {0: 0.9, 5: 0.7}) == ["head", "body", "body", "body", "number", "head", "body", "break", "body", "body", "body", "number"]
    assert S.label_lines([]) == [] and S.label_lines(["", " "]) == ["break", "break"]
    for t in ("l83", "p. 43", "c. 12v", "42/82", "xxxv", "Seite 3", "[12]", "lO5"):
        assert S.NUMBER.match(t), t
    for t in ("col.", "civili.", "Totale 68", "nomi", "1944 e"):
        assert not S.NUMBER.match(t), t


def test_confusions():
    assert S.confusion("testirnone", "testimone") and S.confusion("con5eguenza", "conseguenza") and S.confusion("rcsta", "resta") and S.confusion("погибщим", "погибшим")
    assert not S.confusion("testa", "resta") and not S.confusion("resta", "resta") and not S.confusion("monte", "mondo")


def test_scanned(spark):
    plain = [["Il testimone precisa che la colonna passasse per nord-ovest del monte Alto."]] * 12
    heads = [[f"{n}   Bollettino storico" if n % 2 else "BOLLETTINO STORICO", *x] for n, x in enumerate(plain)]
    recs = [("a", "1", LINES), ("a", "2", ["Il testirnone precisa che la colonna.", None, "poi con5ervato"]), ("a", "3", []), ("a", "4", None), ("a", "5", ["Il fronte del nord-"]), ("a", "6", ["La zona era conser-"])] + [("p", str(i), x) for i, x in enumerate(heads)]
    rows = [(s, k, None if x is None else [(t, None) for t in x]) for s, k, x in recs + recs[:1]]
    df = spark.createDataFrame(rows, "src string, rec_key string, lines array<struct<text string, x0 double>>")
    sc = S.Scanned(df)
    got = {(r.rec_key, r.line_no, r.kind) for r in sc.found().filter("src = 'a'").collect()}
    assert got == {
        ("1", 0, "running_head"), ("1", 5, "running_head"), ("1", 4, "page_number"), ("1", 11, "page_number"), ("1", 1, "broken_word"), ("1", 3, "broken_word"),
        ("2", 0, "char_error"), ("2", 2, "char_error"), ("6", 0, "broken_word"),
    }
    text = {r.rec_key: r.text for r in sc.texts().filter("src = 'a'").collect()}
    assert "registro conservato nel comune" in text["1"] and "annotò il decesso" in text["1"] and "nord-ovest" in text["1"].replace("nord- ovest", "nord-ovest") and "38" not in text["1"]
    assert text["2"].startswith("Il testimone precisa")


def test_words_without_a_true_form_stay(spark):
    page = ["La colonna ukaz4no passò il monte.", "Ukaz4no il fronte della zona", "e UKAZ4NO il resto del giorno."]
    df = spark.createDataFrame([("a", "1", [(t, None) for t in page])], "src string, rec_key string, lines array<struct<text string, x0 double>>")
    sc = S.Scanned(df)
    assert {(r.line_no, r.kind) for r in sc.found().collect()} == {(0, "char_error"), (1, "char_error"), (2, "char_error")}
    text = sc.texts().collect()[0].text
    assert text.split() == " ".join(page).split()


def test_heads_are_learned_and_weights_fitted(spark):
    say = "il registro fu trovato {} nella casa del parroco e la commissione ne prese atto {} senza altro"
    word = lambda n: "".join("abcdefghil"[int(c)] for c in f"{n:04d}")
    rows = [("p", str(i), [(f"Quaderno mai visto, {i}" if i % 3 else "QUADRENO MAI VISTO", None), *[(say.format(word(9 * i + k), word(7 * i + k)), None) for k in range(8)]]) for i in range(30)]
    df = spark.createDataFrame(rows, "src string, rec_key string, lines array<struct<text string, x0 double>>")
    got = {(r.rec_key, r.line_no, r.kind) for r in S.Scanned(df).found().filter("kind = 'running_head'").collect()}
    assert got == {(str(i), 0, "running_head") for i in range(30)}
    w = S.fit_weights([])
    assert w is S.START
    empty = S.head_lines(df.limit(0))
    assert empty.count() == 0


def test_no_body_word_is_lost(spark):
    # words of the labelled body lines in, words of the paragraphs out; a word broken over two lines is one where it is rejoined
    from pyspark.sql import functions as F

    rows = [("p", str(k), [(t, None) for t in x]) for k, x in enumerate([LINES, LINES[2:8], ["Il fronte del nord-", "ovest cedette all'alba."], ["una parola sola"], ["ukaz4no e poi con5ervato", "", "Il monte."], [None, " "]])]
    df = spark.createDataFrame(rows, "src string, rec_key string, lines array<struct<text string, x0 double>>")
    sc = S.Scanned(df)
    joined = sc.broken.select("src", "rec_key", "line_no", F.lit(1).alias("j"))
    lines = sc.body.join(joined, ["src", "rec_key", "line_no"], "left")
    split = F.when(F.col("left") == "", 0).when(F.col("j").isNotNull() | (F.col("right") == ""), 1).otherwise(2)
    want = {r.rec_key: r.n for r in lines.groupBy("rec_key").agg(F.sum(F.size("words") + split).alias("n")).collect()}
    got = {r.rec_key: len(S._words(r.text)) for r in sc.texts().collect()}
    assert {k: n for k, n in got.items() if n} == want
