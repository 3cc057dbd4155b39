import io
import zipfile

from pyspark.sql import functions as F

from fondaco.functions import html as H
from fondaco.operators.attempts import Template, attempts
from fondaco.operators.incremental import set_digest, step_states
from fondaco.operators.phrases import name_tier, phrase_matches
from fondaco.sources import sheets, sinks

PAGE = """<html><h1>Risultati</h1><p>Showing 2 of 40 records</p><h2>Rossi Mario</h2><a class="hit big" href="/d/1">Rossi Mario 1920</a><a href="/d/1#x">altro</a>
<h3>Verdi</h3><a class="hit" href="https://x.example/d/2">Verdi</a><a href="https://y.example/d/3">Rossi fuori</a><a class='hit' href="/d/1">ancora Rossi</a>
<div class="person card"><h4>Ugo Neri</h4><a href="/p/9">vai</a> nato 1901</div><div class="card other"><h4>Ida Blu</h4><a href="p/10">x</a></div><dl><dt>Fondo</dt><dd>Carte <b>A</b></dd><dt>Busta</dt> <dd>7</dd></dl>
<form><input name="q" type="search"><input type="hidden" name="t" value="1"><select name="anno"><option value="">-</option><option value="1943">1943</option></select><textarea name="note"></textarea></form></html>"""


def one(spark, col, text=PAGE):
    return spark.createDataFrame([(text,)], "h string").select(col.alias("x")).first().x


def test_links_and_counts(spark):
    base = F.lit("https://x.example/s/q?a=1")
    got = one(spark, H.candidate_links("h", base, "/d/", "hit"))
    assert [(r.url, r.label) for r in got] == [("https://x.example/d/1", "Rossi Mario 1920"), ("https://x.example/d/2", "Verdi")]
    assert [r.url for r in one(spark, H.candidate_links("h", base, "/d/", exclude=["Verdi", "y[.]example"]))] == ["https://x.example/d/1", "https://x.example/d/1#x"]
    assert [(r.score, r.label) for r in one(spark, H.top_hits("h", base, F.lit("mario ROSSI")))] == [(2, "Rossi Mario 1920")]
    assert tuple(one(spark, H.shown_counts("h"))) == (2, 40) and tuple(one(spark, H.shown_counts("h"), "<a href='x'>y</a>")) == (1, 1)
    assert [(r.url[-1], r.title) for r in one(spark, H.titled_links("h", base, "x.example/d/"))] == [("1", "Rossi Mario"), ("x", "Rossi Mario"), ("2", "Verdi")]
    s = one(spark, H.result_signals("h", base, "/d/"))
    assert s.heading == "Risultati" and s.total == 40 and not s.blocked and not s.nothing and len(s.links) == 4
    assert one(spark, H.result_signals("h", base), "Nessun risultato").nothing and one(spark, H.result_signals("h", base), "CAPTCHA").blocked
    assert one(spark, H.candidate_links("h", base), "") == [] and one(spark, H.candidate_links("h", base), None) is None


def test_cards_forms_and_panels(spark):
    base = F.lit("https://x.example")
    assert [(r.title, r.url) for r in one(spark, H.cards("h", base))] == [("Ugo Neri", "https://x.example/p/9"), ("Ida Blu", "https://x.example/p/10")]
    assert [(r.label, r.value) for r in one(spark, H.panel_hits("h"))] == [("Fondo", "Carte A"), ("Busta", "7")]
    assert [(r.name, r.type, r.options) for r in one(spark, H.form_fields("h"))] == [("q", "search", []), ("t", "hidden", []), ("anno", "choice", ["", "1943"]), ("note", "text", [])]
    two = spark.createDataFrame([(PAGE, PAGE.replace('name="q"', 'name="w"').replace('value="1943"', 'value="1944"'))], "a string, b string")
    assert [tuple(r) for r in two.select(H.form_changes(H.form_fields("a"), H.form_fields("b")).alias("x")).first().x] == [("anno", "changed"), ("q", "removed"), ("w", "added")]
    xml = '<update><![CDATA[<li data-rowkey="0_1" class="node leaf"><span>Akte &amp; Band</span></li><li data-rowkey="0_2"><span>Serie</span></li>]]></update>'
    assert [tuple(r) for r in one(spark, H.tree_nodes("h"), xml)] == [("0_1", "Akte & Band", True), ("0_2", "Serie", False)]


def workbook(rows):
    cells = lambda n, r: "".join(f'<c r="{"ABC"[i]}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(r))
    body = "".join(f'<row r="{n}">{cells(n, r)}</row>' for n, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook([["Cognome", "Nome", "Alias"], ["Rossi", "Mario", ""], ["", "", ""], ["Verdi", "Ugo", "Nino Verdi"]]))
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    rows = sheets.read_workbooks(spark, str(tmp_path))
    got = sorted((r.row_no, r.fields) for r in rows.collect() if r.fields)
    assert got == [(2, {"Cognome": "Rossi", "Nome": "Mario", "Alias": ""}), (4, {"Cognome": "Verdi", "Nome": "Ugo", "Alias": "Nino Verdi"})] and rows.count() == 3
    q = spark.createDataFrame([(1, "ROSSI", "mario"), (2, "Ugo", ""), (3, "Verdi", "Nino"), (4, "Bianchi", "Ida"), (5, None, None)], "id int, family_name string, given_name string")
    assert sorted((r.id, r.row_no) for r in sheets.search_rows(q, rows, "Cognome", "Nome", ["Alias"]).collect()) == [(1, 2), (2, 4), (3, 4)]


def test_recognition_table_and_texts(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    tsv = "\n".join([head, "5\t1\t1\t1\t1\t2\t50\t10\t30\t12\t80.5\tMario", "5\t1\t1\t1\t1\t1\t10\t8\t30\t12\t90\tRossi", "4\t1\t1\t1\t1\t0\t0\t0\t99\t20\t-1\t", "bad row"])
    words = sheets.recognition_words(spark.createDataFrame([("p", tsv), ("q", None), ("r", "")], "k string, t string"), "k", "t")
    line = sheets.recognition_lines(words, "k").collect()
    assert words.count() == 2 and len(line) == 1 and (line[0].text, line[0].confidence, line[0].x0, line[0].y0, line[0].x1, line[0].y1) == ("Rossi Mario", 85.25, 10, 8, 80, 22)
    files = spark.createDataFrame([("a.csv", bytearray(b"nome,anno\nRossi,1920")), ("b.html", bytearray(b"<p>Ciao <b>mondo</b></p>")), ("c.docx", bytearray(b"x")), ("d.bin", bytearray(b"x")), ("e.txt", bytearray("città".encode()))], "path string, content binary")
    got = {r.path: (r.status, r.text) for r in sheets.extract_texts(files).collect()}
    assert got == {"a.csv": ("ok", "Riga 1. nome: Rossi; anno: 1920"), "b.html": ("ok", "Ciao mondo"), "c.docx": ("failed", None), "d.bin": ("unsupported", None), "e.txt": ("ok", "città")}


def test_phrases_and_tiers(spark):
    docs = spark.createDataFrame([(1, "Mario Rossi, detto «Lupo», e ROSSI-Mario."), (2, "Mariorossi"), (3, None), (4, "")], "k int, t string")
    forms = spark.createDataFrame([("mario rossi",), ("lupo",), ("rossi mario",), ("",), (None,)], "form string")
    assert {(r.k, r.form, r.pos) for r in phrase_matches(docs, "k", "t", forms).collect()} == {(1, "mario rossi", 0), (1, "lupo", 3), (1, "rossi mario", 5)}
    assert phrase_matches(docs, "k", "t", forms.limit(0)).count() == 0
    rows = [("il sig. Mario Rossi", "Mario Rossi", "exact"), ("il sig. mario-rossi", "Mario Rossi", "normalised"), ("Rossi, Mario", "Mario Rossi", "reversed"), ("Mariorossi", "Mario Rossi", None), (None, "Mario", None), ("Mario", "", None)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string").select("i", name_tier("a", "b").alias("t")).collect()
    assert [r.t for r in sorted(got, key=lambda r: r.i)] == [t for _, _, t in rows]


def test_attempts_and_steps(spark):
    t = [Template("full", "{g} {f}"), Template("dead", "{f} {d}", unless=("b",)), Template("name", "{f}")]
    rows = spark.createDataFrame([(1, "Mario", "Rossi", None, "1944"), (2, None, "Verdi", "1920", "1944"), (3, None, None, None, None)], "i int, g string, f string, b string, d string")
    got = {r.i: [x.query for x in r.a] for r in rows.select("i", attempts(t, 2).alias("a")).collect()}
    assert got == {1: ["Mario Rossi", "Rossi 1944"], 2: ["Verdi"], 3: []}
    files = lambda *r: spark.createDataFrame(list(r), "step string, path string, sha string")
    a = set_digest(files(("x", "a", "1"), ("x", "b", "2"), ("y", "a", "1"), ("z", "a", None)), ["step"], ["path", "sha"])
    b = set_digest(files(("x", "b", "2"), ("x", "a", "1"), ("y", "a", "9"), ("w", "q", "1")), ["step"], ["path", "sha"])
    assert {tuple(r) for r in step_states(a, b, "step").collect()} == {("x", "skip"), ("y", "run_again"), ("z", "gone"), ("w", "run")}


def test_notes_runs_and_caches(spark, tmp_path):
    notes = str(tmp_path / "notes")
    say = lambda t: spark.createDataFrame([("anna b/c", t), ("ugo", t)], "k string, t string")
    sinks.write_notes(say("# prima"), notes, "k", "t")
    one_file = next(p for p in (tmp_path / "notes").rglob("*.txt") if "ugo" in str(p))
    (one_file.parent / f".{one_file.name}.crc").unlink(missing_ok=True)
    one_file.write_text(f"# prima\n{sinks.OWN_NOTES}\nmio")
    sinks.write_notes(say("# seconda"), notes, "k", "t")
    got = {p.parent.name: p.read_text().strip() for p in (tmp_path / "notes").rglob("*.txt")}
    assert got["k=ugo"] == f"# seconda\n{sinks.OWN_NOTES}\nmio" and len(got) == 2 and "# seconda" in got.values()
    store = str(tmp_path / "s")
    sinks.replace_run(spark.createDataFrame([(1, "r1"), (2, "r2")], "id int, run string"), store, "run")
    sinks.replace_run(spark.createDataFrame([], "id int, run string"), store, "run", ["r1"])
    assert [r.id for r in spark.read.parquet(store).collect()] == [2]
    raw = spark.createDataFrame([(1, "uno"), (2, "uno"), (3, None), (4, "due")], "id int, t string")
    assert sinks.store_raw(raw, str(tmp_path / "raw"), "t", ["id"]) == 2 and sinks.store_raw(raw, str(tmp_path / "raw"), "t", ["id"]) == 0
    asked = []

    def fetch(urls):
        asked.append(sorted(r.url for r in urls.collect()))
        return urls.withColumn("html", F.concat(F.lit("page "), "url"))

    want = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    assert sinks.cached_pages(want("a", "b", "a", None), str(tmp_path / "c"), fetch).count() == 2
    assert {r.html for r in sinks.cached_pages(want("b", "d"), str(tmp_path / "c"), fetch).collect()} == {"page b", "page d"} and asked == [["a", "b"], ["d"]]
    pages = lambda t: spark.createDataFrame([("p1", "x"), ("p2", t)], "k string, t string")
    out = str(tmp_path / "pages")
    assert [sinks.write_pages(pages(t), out, "k", "t", "v1") for t in ("y", "y", "z")] == [2, 0, 1]


def test_nearest_terms_against_brute_force(spark):
    import random

    from fondaco.operators.suggestions import nearest_terms

    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(60)})
    terms = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(40)})

    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    w = spark.createDataFrame([(x,) for x in [*words, None]], "word string")
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    got = {(r.word, r.term, r.edits) for r in nearest_terms(w, t, 2).collect()}
    assert got == {(a, b, slow(a, b)) for a in words for b in terms if a != b and slow(a, b) <= 2}


def test_registry(spark, tmp_path):
    from fondaco.sources import files

    (tmp_path / "r.yaml").write_text("sources:\n  a: {enabled: false, name: Uno, deep: {x: 1}}\n  b: {name: Due}\n")
    (tmp_path / "l.yaml").write_text("sources:\n  - {id: c, url: u}\n  - nothing\n")
    assert {(r.source_id, r.enabled, r.fields["name"]) for r in files.read_registry(spark, str(tmp_path / "r.yaml")).collect()} == {("a", False, "Uno"), ("b", True, "Due")}
    assert [r.source_id for r in files.read_registry(spark, str(tmp_path / "l.yaml")).collect()] == ["c"]
