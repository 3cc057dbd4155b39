import random

import pytest

from fondaco.llm import places as P

ENTRIES = [("1", "Monte Alto", "MA", "Marca"), ("2", "Borgo Alto", "BO", "Borsa"), ("3", "Cavallina", "CA", "Carno"), ("3", "Vecchiana", "CA", "Carno"), ("4", "Ca' di Lunardo", "LU", "Luna"), ("5", "Santa Maria di Gorgona", "GO", "Gorgo")]


def test_metric_and_tree_against_brute_force():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 9))) for _ in range(150)]

    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    tree = P.BKTree(words)
    for w in words[:60]:
        assert all(P.edit_distance(w, v) == slow(w, v) for v in words[:40])
        for k in (0, 1, 2):
            assert tree.within(w, k) == sorted((slow(w, v), v) for v in set(words) if slow(w, v) <= k)


@pytest.mark.parametrize("value,want", [("M.te Alto", "1"), ("Alto, Monte", "1"), ("B.go Alto (BO)", "2"), ("presso Cavalina", "3"), ("VECCHIANA, prov. di Carno", "3"), ("Cà di Lunardo", "4"), ("S. Maria di Gorgnoa", "5"), ("santamariadigorgona", ""), ("Pieve di Alto", ""), ("vedi note", ""), ("Gorgona", "5"), ("Cavallina - Italia", "3"), ("?", "")])
def test_values(value, want):
    b = P.PlaceIndex(ENTRIES).best(value)
    assert (b[1][0] if b and len(b[1]) == 1 else "") == want


def test_two_entries_tie():
    assert len(P.PlaceIndex(ENTRIES).best("Alto")[1]) == 2


@pytest.mark.parametrize("tree_rows", [100, 2])
def test_map_values_broadcast_and_sharded(spark, tree_rows):
    e = spark.createDataFrame(ENTRIES, "entry_id string, label string, code string, province string")
    v = spark.createDataFrame([("Cavalina", 1), ("Cavalina", 2), (None, 3), ("  ", 4), ("Alto", 5), ("x" * 50_000, 6)], "value string, entry_id int")
    got = {r.value[:10]: r.entry_id for r in P.map_values(v, e, tree_rows).collect()}
    assert got == {"Cavalina": "3", "Alto": "", "x" * 10: ""}
    assert P.map_values(v, e.limit(0)).filter("entry_id <> ''").count() == 0
    assert P.map_values(v.limit(0), e).count() == 0


def test_sharded_list_against_the_single_tree(spark):
    import random

    rnd = random.Random(2)
    parts = "ba co di fu ga lo mi ne pu ro sa te vi zo".split()
    names = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randint(3, 6))) for _ in range(3_000)})
    e = spark.createDataFrame([(f"e{i}", n, "", "") for i, n in enumerate(names)], "entry_id string, label string, code string, province string")
    slips = [n[:i] + rnd.choice("aeio") + n[i + 1 :] for n in names[::7] for i in (2, 4)] + ["zz" * 9]
    v = spark.createDataFrame([(x,) for x in slips + names[::50]], "value string")
    one = {tuple(r) for r in P.map_values(v, e).collect()}
    assert one == {tuple(r) for r in P.map_values(v, e, 400).collect()} and len({r[1] for r in one}) > 50
