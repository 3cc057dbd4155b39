import random

import numpy as np
from pyspark.sql import functions as F

from fondaco.operators import documents as D
from fondaco.plans.text import text_pairs


def brute(rows, threshold):
    vec = {}
    for k, t, w in rows:
        vec.setdefault(k, {})[t] = w
    norm = {k: sum(x * x for x in v.values()) ** 0.5 for k, v in vec.items()}
    dot = lambda a, b: sum(x * vec[b].get(t, 0) for t, x in vec[a].items()) / norm[a] / norm[b]
    keys = sorted(vec)
    return {(a, b): c for n, a in enumerate(keys) for b in keys[n + 1 :] if (c := dot(a, b)) >= threshold}


def made(n, vocabulary, seed=4):
    """Texts over few words: any two share some, and a third of them are near copies of others."""
    rnd, texts = random.Random(seed), []
    for _ in range(n):
        t = dict(rnd.choice(texts)) if texts and rnd.random() < 0.3 else {rnd.randrange(vocabulary): rnd.random() + 0.1 for _ in range(rnd.randint(1, 30))}
        t[rnd.randrange(vocabulary)] = rnd.random() * 0.5 + 0.1
        texts.append(t)
    return [(f"k{i}", f"w{t}", w) for i, v in enumerate(texts) for t, w in v.items()]


def test_cosine_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)  # many blocks
    rows = made(150, 60)
    for threshold in (0.5, 0.86):
        want = brute(rows, threshold)
        got = D.cosine_pairs(spark.createDataFrame(rows, "id string, term string, w double"), "id", threshold).collect()
        assert want and len(got) == len(want)
        assert all(abs(r.cosine - want[r.a, r.b]) < 1e-9 for r in got)
    assert D.cosine_pairs(spark.createDataFrame([], "id long, term string, w double"), "id", 0.5).collect() == []


def test_no_rows_of_pairs_that_are_no_results(spark):
    """No pair is a row before it is a result: nothing is joined by term, no exchange holds pairs."""
    rows = made(40, 20)
    df = D.cosine_pairs(spark.createDataFrame(rows, "id string, term string, w double"), "id", 0.86)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_blocks_of_small_memory(monkeypatch):
    monkeypatch.setattr(D, "CELLS", 50)
    rnd = np.random.default_rng(2)
    n = rnd.integers(1, 12, 30)
    t = np.concatenate([rnd.choice(40, k, replace=False) for k in n]) * 7 - 100  # hashes may be negative
    w = rnd.random(n.sum()) + 0.01
    w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, np.cumsum(n) - n)), n)
    dense = np.zeros((30, 300))
    dense[np.repeat(np.arange(30), n), t + 100] = w
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if dense[i] @ dense[j] >= 0.3}
    got = [(int(x), int(y)) for i, j, _ in D.block_cosines((n, t, w), (n, t, w), 0.3, True) for x, y in zip(i, j)]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_tfidf_pairs_of_token_arrays(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)
    rnd, words = random.Random(7), [f"w{k}" for k in range(40)]
    texts = [(i, rnd.choices(words, k=rnd.randint(0, 300))) for i in range(120)]  # terms that stand more often than a byte counts
    texts += [(200 + i, t + ["w1"]) for i, t in texts[:30]] + [(300, ["x"] * 70_000 + ["y"]), (301, ["x"] * 70_001), (302, ["lone"])]
    least = 5
    df = spark.createDataFrame(texts, "id long, t array<string>")
    weights = D.tfidf(df.filter(F.size("t") >= least).select("id", F.explode("t").alias("term")), "id")
    want = brute([tuple(r) for r in weights.select("id", "term", "w").collect()], 0.86)
    got = D.tfidf_pairs(df, "id", "t", 0.86, least).collect()
    assert {(300, 301)} < set(want) and len(got) == len(want) and {(r.a, r.b) for r in got} == set(want)
    assert all(abs(r.cosine - want[r.a, r.b]) < 1e-9 for r in got)


def test_no_rows_of_terms_of_a_text(spark, monkeypatch, tmp_path):
    """No written table has a row for each text and term, and no step spreads texts to terms before they are blocks (F4: those rows filled the disk)."""
    rnd, words = random.Random(3), [f"wort{k:03d}" for k in range(400)]
    texts = [(i, " ".join(rnd.sample(words, 120))) for i in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cuts, plans, cut = [], [], D.cut

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        cuts.append(cut(df))
        return cuts[-1]

    monkeypatch.setattr(D, "cut", kept)
    monkeypatch.setattr(D, "forget", lambda *tables: None)
    assert text_pairs(spark, str(tmp_path)).collect() == []
    assert "Generate" not in plans[0] and len(cuts) == 3
    assert all(t.count() <= len(texts) for t in cuts)  # of 48,000 terms of texts
