from pyspark.sql import functions as F

from fondaco.operators.documents import boundaries, boundary_chunks, components, cosine_pairs, stride_chunks, tfidf
from fondaco.operators.relational import dense_histogram, first_wins, hash_id, insert_new, islands, multiset_common, newest, snapshot_diff, unique_match
from fondaco.operators.rules import captures, first_rule, messages


def test_versions_and_diffs(spark):
    a = spark.createDataFrame([("x", 1, "p"), ("x", 2, "q"), ("y", 1, None)], "k string, at int, v string")
    assert {(r.k, r.v) for r in newest(a, "k", "at", ["v"]).collect()} == {("x", "q"), ("y", None)}
    assert {(r.k, r.at) for r in first_wins(a, ["k"], [F.col("at")]).collect()} == {("x", 1), ("y", 1)}
    assert [r.k for r in insert_new(a.filter("k = 'x'"), a, "k", [F.col("at")]).collect()] == ["y"]
    b = spark.createDataFrame([("x", "q"), ("z", "n")], "k string, v string")
    got = {r.k: r.change for r in snapshot_diff(spark.createDataFrame([("x", "p"), ("y", "o")], "k string, v string"), b, "k", "v").collect()}
    assert got == {"x": "modified", "y": "removed", "z": "added"}


def test_histogram_unique_match_and_multisets(spark):
    df = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "s string")
    assert {r.s: r.n for r in dense_histogram(df, "s", ["a", "b"]).collect()} == {"a": 2, "b": 0}
    cat = spark.createDataFrame([("k", "p1"), ("k", "p2"), ("m", "p3"), ("m", "p3")], "s string, place string")
    m = spark.createDataFrame([("k",), ("m",), ("n",)], "s string")
    assert {r.s: (r.matches, r.place) for r in unique_match(m, cat, "s", "place").collect()} == {"k": (2, None), "m": (1, "p3"), "n": (0, None)}
    assert {r.s: r.n for r in multiset_common(df, spark.createDataFrame([("a",), ("b",)], "s string"), ["s"]).collect()} == {"a": 1}


def test_islands_and_ids(spark):
    df = spark.createDataFrame([("p", 1, 0.0), ("p", 2, 3.0), ("p", 3, 50.0), ("p", 4, 2.0)], "k string, o int, gap double")
    got = [r.island for r in islands(df, ["k"], "o", (F.col("o") == 1) | (F.col("gap") > 10)).orderBy("o").collect()]
    assert got == [1, 1, 2, 2]
    one = spark.range(1).select(hash_id("c-", F.lit("a"), F.lit(None)).alias("x"), hash_id("c-", F.lit("a"), F.lit("")).alias("y")).first()
    assert one.x == one.y and len(one.x) == 18


def test_chunks(spark):
    text = "Uno. " * 400
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "kurz")], "id int, t string")
    c = stride_chunks(df, "id", "t", 100, 10).filter("id = 1").orderBy("chunk_index").collect()
    assert c[-1].char_end == len(text) and "".join(r.chunk if i == 0 else r.chunk[10:] for i, r in enumerate(c)) == text
    spans = boundaries(text, 100, 10)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b > a and n <= b for (a, b, _), (n, _, _) in zip(spans, spans[1:]))
    assert {k for _, _, k in spans} <= {"sentence", "blank", "hard", "end", "paragraph"}
    assert boundary_chunks(df, "id", "t", 100, 10).filter("id = 4").first().chunk == "kurz"


def brute(docs):
    import math

    toks = {k: t.split() for k, t in docs.items()}
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    vec = {}
    for k, t in toks.items():
        v = {w: t.count(w) * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w in set(t)}
        n = math.sqrt(sum(x * x for x in v.values()))
        vec[k] = {w: x / n for w, x in v.items()}
    return {(a, b) for a in docs for b in docs if a < b and sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) >= 0.7}


def test_similarity_and_components(spark):
    docs = {f"d{i}": " ".join(f"w{(i * 7 + j * (1 + i % 3)) % 23}" for j in range(8)) for i in range(40)} | {"x": "w1 w2 w3 rare", "y": "w1 w2 w3 rare", "z": "alone"}
    rows = spark.createDataFrame([(k, w) for k, t in docs.items() for w in t.split()], "id string, term string")
    pairs = cosine_pairs(tfidf(rows, "id"), "id", 0.7)
    got = {(r.a, r.b) for r in pairs.collect()}
    assert got == brute(docs)
    comp = {r.node: r.component for r in components(pairs).collect()}
    assert comp["x"] == comp["y"] == min(k for k, c in comp.items() if c == comp["x"])
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components(path).collect()} == {0}


def test_rules(spark):
    df = spark.createDataFrame([(0, "a"), (2, "b"), (9, None), (None, "a")], "n int, s string")
    rule = first_rule([{"id": "none", "when": {"n": 0}}, {"id": "some", "when": {"n": {"between": [1, 3]}, "s": {"in": ["b"]}}}], {"n": F.col("n"), "s": F.col("s")}, "other")
    assert [r.v for r in df.select(rule.alias("v")).collect()] == ["none", "some", "other", "other"]
    m = messages([(F.col("n") > 1, "many"), (F.col("s") == "b", "b")], "fine")
    assert [r.m for r in df.select(m.alias("m")).collect()] == [["fine"], ["many", "b"], ["many"], ["fine"]]
    c = captures(F.lit("nato il 3 maggio 1920, x"), {"born": [r"geb\. (\w+)", r"nato il ([^,]+)"]})
    assert spark.range(1).select(c["born"].alias("b")).first().b == "3 maggio 1920"
