"""No side behind an explode is broadcast by Spark's estimate, which is the size of the file that it comes from."""

import random

import pytest

from fondaco.llm import linkage as L
from fondaco.llm import register as R
from fondaco.session import cut


@pytest.fixture(scope="module")
def words(spark):
    rnd = random.Random(7)
    made = sorted({"".join(rnd.choice("abdegilmnorstuv") for _ in range(rnd.randint(6, 10))) for _ in range(300)})
    return cut(spark.createDataFrame([(i, "x", "lr", w) for i, w in enumerate(made)], "form long, block string, role string, word string"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcasts(p):
    """The parts of a plan below each broadcast."""
    lines = p.splitlines()
    deep = [next((i for i, c in enumerate(x) if c.isalpha()), 0) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if deep[j] <= deep[i]), len(lines))
            yield "\n".join(lines[i + 1 : end])


def test_keys_of_edits_are_shuffled(words):
    assert "BroadcastHashJoin" not in plan(L.edit_pairs(words))


def test_grams_and_vectors_are_shuffled(words):
    vectors = L.gram_vectors(words)
    assert "BroadcastHashJoin" not in plan(vectors)
    assert "BroadcastHashJoin" not in plan(L.with_cosine(L.edit_pairs(words), vectors))
    assert "BroadcastHashJoin" not in plan(L.similar_forms(vectors, words.selectExpr("form", "block", "length(word) AS size")))


def test_retrieval_keys_are_shuffled(spark, monkeypatch):
    rows = [(1, "Mario Rossettini", "3.5.1920", "1944"), (2, "Carlo Vallonara", "1921", None)]
    reg = spark.createDataFrame(rows, "caduto_id long, nome string, nascita string, morte string")
    doc = spark.createDataFrame([("d", "Lapide di Mario Rossettini, nato 3.5.1920")], "document_id string, title string")
    plans = []
    monkeypatch.setattr(R, "cut", lambda df: (plans.append(plan(df)), cut(df))[1])
    out = R.match_titles(reg, doc, "caduto_id", "nome", "nascita", "morte", "document_id", "title")
    assert [(r.caduto_id, r.document_id) for r in out.collect()] == [(1, "d")]
    exploded = [p for p in plans if "qv#" in p and "iv#" in p]
    assert exploded
    for p in exploded:  # the two tables and the near names may be broadcast, but not their keys, tokens and vectors
        assert not [x for x in broadcasts(p) if "Generate" in x or "collect_list" in x]
