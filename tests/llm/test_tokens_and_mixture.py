import os
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fondaco.llm import tokens as K
from fondaco.llm.mixture import mix, period, pfair, plan

PATH = K.vocabulary()
needs = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@needs
@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_round_trip_and_offsets(text):
    ids = K.encode_texts([text], PATH)[0]
    assert K.decode_ids(ids, PATH) == text
    spans = K.byte_offsets(ids, PATH)
    assert "".join(text.encode()[a:b].decode("latin-1") for a, b in spans) == text.encode().decode("latin-1")
    for (a, b), (c, d) in zip(spans, K.char_offsets(text, spans)):
        assert len(text[:c].encode()) <= a and b <= len(text[:d].encode())


@needs
def test_special_strings_split_characters_and_nulls(spark):
    emoji = "\U0001f54a"
    ids = K.encode_texts([emoji], PATH)[0]
    assert len(ids) > 1 and "�" in K.decode_ids(ids[:1], PATH) and K.decode_ids(ids, PATH) == emoji
    df = spark.createDataFrame([(1, "<|endoftext|> x", 5), (2, "", 6), (3, None, 7), (4, "a" * 200_000, 8), (1, "<|endoftext|> x", 5)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in K.encode(df, "doc_id", "text", PATH).collect()}
    assert got[2] == [] and got[3] == [] and 50256 not in got[1] and K.decode_ids(got[4], PATH) == "a" * 200_000
    assert K.encode(df.limit(0), "doc_id", "text", PATH).count() == 0
    back = K.encode(df, "doc_id", "text", PATH).select("doc_id", K.decode("ids", PATH).alias("t"))
    assert {r.doc_id: r.t for r in back.collect()}[1] == "<|endoftext|> x"
    off = {r.doc_id: r for r in K.encode_with_offsets(df, "doc_id", "text", PATH).collect()}
    assert off[1].byte_end[-1] == 15 and off[3].char_end == []


@needs
def test_same_ids_as_the_rank_file():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(K.vocabulary(name="byte_bpe_50k.tiktoken"), "rb"))}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for t in ("Il 3 maggio 1944, a Ca' di Monte.", "Книга погребений", "  zwei\n\nZeilen \t"):
        assert K.encode_texts([t], PATH)[0] == e.encode_ordinary(t)


def test_pfair_stays_within_one_block():
    w = {"a": Fraction(1, 2), "b": Fraction(3, 10), "c": Fraction(1, 5)}
    order = pfair(w, 200)
    seen = dict.fromkeys(w, 0)
    for t, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[k] - w[k] * t) < 1 for k in w)
    with pytest.raises(ValueError):
        pfair({"a": Fraction(1, 2)}, 3)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=8))
def test_pfair_any_weights(parts):
    w = {f"s{i}": Fraction(p, sum(parts)) for i, p in enumerate(parts)}
    seen = dict.fromkeys(w, 0)
    for t, s in enumerate(pfair(w, 150), 1):
        seen[s] += 1
        assert all(abs(seen[k] - w[k] * t) < 1 for k in w)


def test_plan_limits():
    total, want = plan([("a", 0.5, 1, 100), ("b", 0.25, 4, 20), ("c", 0.25, 1, 0)])
    assert set(want) == {"a", "b"} and total == 150 and want["a"] == (Fraction(2, 3), 100)
    assert plan([]) == (0, {}) and plan([("a", 1.0, 1, 10)], 4)[0] == 4


def test_mixture(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 500, "big").when(F.col("id") < 540, "small").when(F.col("id") < 590, "none").alias("source"), (F.col("id") % 7 * 10).alias("n_tokens"))
    goals = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("gone", 0.1, 2), (None, 0.5, 1), ("big", 0.6, 1)], "source string, target_share double, max_repeats int")
    m = mix(docs, goals)
    s = {r.source: r for r in m.shares.collect()}
    assert set(s) == {"big", "small", "gone"} and s["gone"].tokens == 0
    assert abs(s["big"].actual_share - 2 / 3) < 0.02 and s["small"].most_copies <= 3
    rows = m.mixed.toPandas()
    assert rows.groupby(["doc_id", "copy"]).size().max() == 1 and rows.groupby("doc_id").size().max() <= 3
    assert mix(docs.limit(0), goals).mixed.count() == 0


def test_schedule_repeats():
    w = {"a": Fraction(1, 2), "b": Fraction(3, 10), "c": Fraction(1, 5)}
    assert period(w) == (10, w) and pfair(w, 40) == pfair(w, 10) * 4
    odd = {"a": Fraction(1, 3), "b": Fraction(1, 7), "c": Fraction(11, 21) - Fraction(1, 10**9), "d": Fraction(1, 10**9)}
    n, rounded = period(odd, 100)
    assert n == 100 and sum(rounded.values()) == 1 and all(v > 0 and (v * n).denominator == 1 for v in rounded.values())


def test_mixture_of_many_periods(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], 2_000) for i in range(600)], "doc_id long, source string, n_tokens long")
    goals = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 3), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    m = mix(docs, goals)
    rows = sorted((r.slot, r.source, r.n_tokens) for r in m.mixed.collect())
    share, seen, all_ = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0, "b": 0, "c": 0}, 0
    assert m.period == 10 and rows[-1][0] > 10 * m.period
    for k, (slot, s, n) in enumerate(rows):
        seen[s] += n
        all_ += n
        if k + 1 == len(rows) or rows[k + 1][0] != slot:
            assert all(abs(seen[x] - share[x] * (slot + 1) * m.slot_tokens) < 2 * m.slot_tokens for x in share)


def test_a_share_of_less_than_a_slot_is_kept(spark):
    docs = spark.createDataFrame([(i, "a", 1_900) for i in range(10)] + [(100 + i, "b", 100) for i in range(5)], "doc_id long, source string, n_tokens long")
    m = mix(docs, spark.createDataFrame([("a", 0.98, 1), ("b", 0.02, 1)], "source string, target_share double, max_repeats int"))
    share = {r.source: r.actual_share for r in m.shares.collect()}
    assert 0.01 < share["b"] < 0.03 and share["a"] + share["b"] == 1.0
