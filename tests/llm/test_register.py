import pytest

from fondaco.llm.register import match_titles, title_person


@pytest.mark.parametrize("title,want", [
    ("Lapide di Mario Rossetti (1920 – 3.5.1944)", ("m", "rossetti", "mario", "1920", "1944-05-03")), ("Verlustmeldung Di Valle Aldo, gef. 18. Januar 1945 (Monte)", ("a", "divalle", "aldo", "", "1945-01-18")),
    ("Personalakte Rossetti Karl, geb. 13.8.1927 a Monte", ("k", "rossetti", "karl", "1927-08-13", "")), ("ROSSETTI, Etto., classe 1911, dichiarazione di irreperibilità, m. 27.1.1944", ("e", "rossetti", "ettore", "1911", "1944-01-27")),
    ("Dossier individuel Rossetti Ondina M. 1917/1943", ("o", "rossetti", "ondina", "1917", "1943")), ("", None), (None, None),
])
def test_titles(title, want):
    assert title_person(title) == want


def test_matches(spark):
    reg = spark.createDataFrame([
        (1, "Mario Rossettini", "1920", "3 maggio 1944", "x"), (2, "ROSSETTINI Mario", None, "03/05/1944", "x"), (3, "Mario Rossettini", "1931", "1945", "x"), (4, "Carlo Rossettini", "1920", None, "x"), (5, None, "1920", None, "x"), (6, "  ", None, None, "x"),
        (1, "Mario Rossettini", "1920", "3 maggio 1944", "x"), *[(100 + i, f"Aldo Cognome{'abcdefghij'[i]}ini", str(1900 + i), None, "x") for i in range(10)],
    ], "caduto_id long, nome string, nascita string, morte string, score string")
    docs = spark.createDataFrame([("d1", "Lapide di Mario Rossetini (1920 - 1944)"), ("d2", "Scheda biografica di Mario Rossettini, n. 1931"), ("d3", "Lapide di Mario Rossettini (1860 - 1917)"), ("d4", "Rapport sur Monte Alto"), ("d5", None), ("d6", ""), ("d1", "Lapide di Mario Rossetini (1920 - 1944)")], "document_id string, title string")
    m = match_titles(reg, docs, "caduto_id", "nome", "nascita", "morte", "document_id", "title")
    got = {(r.caduto_id, r.document_id) for r in m.collect()}
    assert got >= {(1, "d1"), (3, "d2")} and not {d for _, d in got} & {"d3", "d4", "d5", "d6"} and (3, "d1") not in got and (4, "d1") not in got
    assert all(0 <= r.confidence <= 1 for r in m.collect())
    assert match_titles(reg.limit(0), docs, "caduto_id", "nome", "nascita", "morte", "document_id", "title").count() == 0


def test_a_misspelling_that_occurs_often(spark):
    # ten rows and titles under a misspelling, a thousand under the surname
    reg = spark.createDataFrame([(i, f"{'Aldo Bruno Carlo Dario Ettore'.split()[i % 5]} Rossettini", str(1800 + i // 5), "1944") for i in range(1000)] + [(2000 + i, f"Aldo Cognome{'abcdefghij'[i]}ini", str(1900 + i), None) for i in range(10)], "caduto_id long, nome string, nascita string, morte string")
    docs = spark.createDataFrame([(f"d{i}", f"Lapide di Aldo Rossetini ({1800 + i} - 1944)") for i in range(10)], "document_id string, title string")
    got = {(r.caduto_id, r.document_id) for r in match_titles(reg, docs, "caduto_id", "nome", "nascita", "morte", "document_id", "title").collect()}
    assert got == {(5 * i, f"d{i}") for i in range(10)}


def test_an_undated_title_on_a_frequent_name(spark):
    # a third of a small register bears the surname and nothing else is known: the score is low, but nothing contradicts
    reg = spark.createDataFrame([(1, "Q. Rossettini", None, None), (2, "Aldo Rossettini", "1901", None), (3, "Bruno Rossettini", "1902", None), (4, "Carlo Rossettini", "1903", None), *[(10 + i, f"Dario Cognome{'abcdefgh'[i]}ini", None, None) for i in range(8)]], "caduto_id long, nome string, nascita string, morte string")
    docs = spark.createDataFrame([("d1", "Lapide di Quinto Rossettini"), ("d2", "Lapide di Aldo Rossettini"), ("d3", "Lapide di Zeno Rossettini")], "document_id string, title string")
    got = {(r.caduto_id, r.document_id) for r in match_titles(reg, docs, "caduto_id", "nome", "nascita", "morte", "document_id", "title").collect()}
    assert got == {(1, "d1"), (2, "d2")}


def test_an_undated_row_beside_namesakes(spark):
    # the undated row is nearest; rows that contradict each other don't come along, a row that nothing contradicts does
    reg = spark.createDataFrame([(1, "Mario Rossettini", None, None), (2, "Mario Rossettini", "1920", None), (3, "Mario Rossettini", "1931", None), (4, "Carlo Moncolinza", None, None), (5, "Carlo Moncolinza", "1920", None), *[(10 + i, f"Dario Cognome{'abcdefgh'[i]}ini", None, None) for i in range(8)]], "caduto_id long, nome string, nascita string, morte string")
    docs = spark.createDataFrame([("d1", "Lapide di Mario Rossettini"), ("d2", "Lapide di Carlo Moncolinza"), ("d3", "Lapide di Mario Rossettini (1931 - 1944)")], "document_id string, title string")
    got = {(r.caduto_id, r.document_id) for r in match_titles(reg, docs, "caduto_id", "nome", "nascita", "morte", "document_id", "title").collect()}
    assert got == {(1, "d1"), (4, "d2"), (5, "d2"), (1, "d3"), (3, "d3")}


def test_retrieval_keys_against_all_pairs(spark):
    # a pair shares a key exactly if nothing contradicts, or if initial and both full dates agree
    import itertools
    import random

    from fondaco.llm import register as R

    rnd = random.Random(7)
    dates = ["", "1920", "1920-05", "1920-05-03", "1921-01-01"]
    deaths = ["", "1944", "1944-06-01", "1945"]
    rows = [(i, rnd.choice(["m", "c", "m"]), rnd.choice(["rossetti", "bianchini"]), rnd.choice(["mario", "marco", "", "mar*", "~enico"]), rnd.choice(dates), rnd.choice(deaths)) for i in range(60)]
    df = spark.createDataFrame([(*r, True) for r in rows], "key long, initial string, surname string, given string, birth string, death string, own boolean")
    t, r = R._keys(df, True).selectExpr("key AS a", "k"), R._keys(df, False).selectExpr("key AS b", "k")
    got = {(x.a, x.b) for x in t.join(r, "k").select("a", "b").distinct().collect()}
    loose = lambda g: g == "" or "*" in g or "~" in g

    def meets(x, y):
        _, ia, sa, ga, ba, da = x
        _, ib, sb, gb, bb, db = y
        if ia == ib and len(ba) == len(da) == 10 and (ba, da) == (bb, db):
            return True
        if (ia, sa) != (ib, sb):
            return False
        if ba and bb:
            return ba[:4] == bb[:4]
        if da and db:
            return da[:4] == db[:4]
        return loose(ga) or loose(gb) or ga == gb

    assert got == {(x[0], y[0]) for x, y in itertools.product(rows, rows) if meets(x, y)}


def test_rows_keep_titles_that_agree_with_their_nearest(spark):
    from fondaco.llm import register as R

    reg = spark.createDataFrame([(1, "Rossetti M.", None, None)] + [(k, f"Altro Nome{'abcdefghij'[k % 10]}lli", "1900", None) for k in range(10, 20)], "id long, nome string, nascita string, morte string")
    doc = spark.createDataFrame([("a", "Lapide di Mario Rossetti, nato il 3 maggio 1920"), ("b", "Lapide di Mario Rossetti, nato il 3 maggio 1920"), ("c", "Lapide di Rossetti M."), ("d", None), ("e", "")], "doc string, titolo string")
    got = {(r.id, r.doc) for r in R.match_titles(reg, doc, "id", "nome", "nascita", "morte", "doc", "titolo").collect()}
    assert (1, "a") in got and (1, "b") in got and all(x[0] == 1 for x in got)
