import random

import pytest

from fondaco.llm import linkage as L
from fondaco.llm import names as N


@pytest.mark.parametrize("raw,want", [
    ("Rossetti Mario", ("person", "m", "rossetti", "mario")), ("cap. magg. BEPPE Rossetti", ("person", "g", "rossetti", "giuseppe")), ("Rossetti, E.", ("person", "e", "rossetti", "")),
    ("Etto. Rossetti fu Primo", ("person", "e", "rossetti", "ettore")), ('Aldo "Lupo" Della Valletta', ("person", "a", "dellavalletta", "aldo")), ("Dom.co Rossetti", ("person", "d", "rossetti", "domenico")),
    ("CLN Vallona", ("cln", "#cln", "vallona", "")), ("Vallona (Feldkommando)", ("feldkommando", "#feldkommando", "vallona", "")), ("Vallona, brigata", ("brigata", "#brigata", "vallona", "")), ("Serg. Rossetti", ("person", "s", "rossetti", "serg*")),
])
def test_names(raw, want):
    assert N.parse_name(raw) == want


def test_unreadable_names_and_dates():
    assert N.parse_name("?") is None and N.parse_name("A.") is None
    for raw, want in (("15-III-1921", "1921-03-15"), ("2 apr. 1889", "1889-04-02"), ("Monte, 27/11/1916", "1916-11-27"), ("maggio 1945", "1945-05"), ("12 мая 1944", "1944-05-12"), ("di Giuseppe 1909", "1909"), ("ignota", "")):
        assert N.parse_date(raw) == want
    assert N.dates_agree("1920", "1920-05-01") and not N.dates_agree("1920-05", "1920-06-01")


COLS = "key string, name string, birth string, death string, place string"


def clusters(spark, rows):
    got = {}
    for r in L.link_names(spark.createDataFrame(rows, COLS)).collect():
        got.setdefault(r.cluster, set()).add(r.key)
    return sorted(map(sorted, got.values()))


def test_links(spark):
    rows = [
        ("1", "Mario Rossettini", "1920", None, None), ("2", "ROSSETTINI Mario", "3.5.1920", "1944", None), ("3", "M. Rossettini", "1920-05-03", None, None), ("4", "Mario Rossettini", "1931", None, None),
        ("5", "Rosettini, Mario", "3 maggio 1920", None, None), ("6", "Carlo Rossettini", "1920", None, None), ("7", "Brg. Vallonara", None, None, None), ("8", "Brigata d'assalto Vallonara", None, None, None), ("9", "CLN Vallonara", None, None, None),
        ("a", None, None, None, None), ("b", "  ", None, None, None), ("7", "Brg. Vallonara", None, None, None),
    ]
    assert clusters(spark, rows) == [["1", "2", "3", "5"], ["4"], ["6"], ["7", "8"], ["9"]]
    assert clusters(spark, [("a", None, None, None, None)]) == []


def test_sparse_join_against_brute_force(spark):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice(["ba", "co", "di", "fu", "ga", "lo"]) for _ in range(rnd.randint(2, 4))) for _ in range(90)})
    forms = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "form long, word string")
    vectors, blocks = L.gram_vectors(forms), forms.selectExpr("form", "'x' AS block", "length(word) AS size")
    got = {(r.a, r.b): r.cosine for r in L.similar_forms(vectors, blocks, 0.5).collect()}
    import math

    grams = [{("^" + w + "$")[i : i + n] for n in (2, 3) for i in range(len(w) + 3 - n)} for w in words]
    df = {}
    for g in grams:
        for x in g:
            df[x] = df.get(x, 0) + 1
    vec = []
    for g in grams:
        v = {x: math.log(1 + len(words) / (df[x] + 5)) for x in g}
        n = math.sqrt(sum(y * y for y in v.values()))
        vec.append({x: y / n for x, y in v.items()})
    want = {(a, b): c for a in range(len(words)) for b in range(a + 1, len(words)) if (c := sum(y * vec[b].get(x, 0) for x, y in vec[a].items())) >= 0.5 and abs(len(words[a]) - len(words[b])) <= 2}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_average_linkage_against_brute_force(spark):
    rnd = random.Random(5)
    n = 24
    sim = {(a, b): round(rnd.random(), 3) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.4}
    groups = {i: [i] for i in range(n)}

    def mean(x, y):
        return sum(sim.get((min(i, j), max(i, j)), 0) for i in groups[x] for j in groups[y]) / (len(groups[x]) * len(groups[y]))

    while True:
        best = max(((mean(x, y), -x, -y) for x in groups for y in groups if x < y), default=(0, 0, 0))
        if best[0] < 0.5:
            break
        groups[-best[1]] += groups.pop(-best[2])
    nodes = spark.createDataFrame([(i, "", "", "") for i in range(n)], "node long, given string, birth string, death string")
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in sim.items()], "a long, b long, sim double")
    got = {}
    for r in L.average_linkage(nodes, pairs).collect():
        got.setdefault(r.cluster, []).append(r.node)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_usual_spelling_is_relative(spark):
    # 10 beside 1,000 is a slip, 30 beside 60 isn't; a slip of a slip is led to the end of the chain
    words = spark.createDataFrame([("rossettini", 1000), ("rossetini", 10), ("rosetini", 1), ("moncolinza", 60), ("moncolinzo", 30)], "word string, n long")
    assert {tuple(r) for r in L.usual_spelling(words).collect()} == {("rossetini", "rossettini"), ("rosetini", "rossettini")}


def test_one_edit_pairs_against_brute_force(spark):
    # all pairs one edit apart, whatever the size of the vocabulary: the cosine alone loses some in the larger one
    from fondaco.llm.places import swap_distance

    rnd = random.Random(11)
    parts = ["ba", "co", "di", "fu", "ga", "lo", "ni", "vi"]
    base = sorted({"".join(rnd.choice(parts) for _ in range(4)) for _ in range(40)})

    def slip(w):
        i = rnd.randrange(len(w) - 1)
        return rnd.choice([w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i + 1 :], w[:i] + rnd.choice("xyz") + w[i + 1 :], w[:i] + "q" + w[i:]])

    words = sorted(set(base) | {slip(w) for w in base for _ in range(2)} | {"buvinina", "bvuinina"})
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if swap_distance(a, b) == 1}
    for more in (0, 10 * len(words)):
        rest = ["".join(rnd.choice(["ro", "ste", "pa", "mi", "zu", "nna"]) for _ in range(5)) + str(i) for i in range(more)]
        forms = spark.createDataFrame([(w, "x", "lr", w) for w in words + rest], "form string, block string, role string, word string")
        got = {(r.a, r.b) for r in L.edit_pairs(forms).collect()}
        assert want and not want - got and all(swap_distance(a, b) == 1 for a, b in got)
