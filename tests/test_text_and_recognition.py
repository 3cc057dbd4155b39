import math

from pyspark.sql import functions as F

from fondaco.functions import text as T
from fondaco.operators.recognition import align, bound_column, common_order, tile_offsets, token_alignment, upper_bounds


def one(spark, col, value="x"):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("v")).first().v


def test_normal_forms(spark):
    assert one(spark, T.label_form("t"), " Ca' di  Monte-Alto! ") == "ca di monte alto"
    assert one(spark, T.order_free("t"), "Rossi Mario") == one(spark, T.order_free("t"), "mario, rossi")
    assert one(spark, T.slug("t"), "Città à côté") == "citta-a-cote"
    assert one(spark, T.latin_tokens("t"), "È già il 1944") == ["gia", "1944"]
    assert one(spark, T.word_tokens("t"), "Книга №1, über") == ["книга", "1", "über"]
    assert one(spark, T.script("t"), "Книга и x") == "cyrillic" and one(spark, T.script("t"), "12 !") == "none"
    assert one(spark, T.label_form("t"), None) is None


def test_dates(spark):
    for raw, want in (("nato il 3 maggio 1920", "1920-05-03"), ("1944-01-02", "1944-01-02"), ("2.11.1943", "1943-11-02"), ("ignota", None), (None, None)):
        assert one(spark, T.iso_date("t"), raw) == want
    assert one(spark, T.first_year("t"), "foglio 12345, 1944") == "1944" and one(spark, T.first_year("t"), "12345") is None


def test_html(spark):
    page = "<html><title> A &amp;\n B </title><script>x<y</script><h1>Kopf <b>fett</b></h1><a href='/d/1'>Eins</a><a href=\"/d/2\"><i>Zwei</i></a><input type='hidden' name='k' value='1'><input type='hidden' name='k' value='2'></html>"
    assert one(spark, T.page_title("t"), page) == "A &amp; B"
    assert one(spark, T.page_heading("t"), page) == "Kopf fett"
    assert [(r.url, r.label) for r in one(spark, T.page_links("t"), page)] == [("/d/1", "Eins"), ("/d/2", "Zwei")]
    assert one(spark, T.hidden_inputs("t"), page) == {"k": "2"}
    assert one(spark, T.strip_tags("t"), "a<br>&lt;b&gt; c") == "a <b> c"


def test_alignment_and_order(spark):
    assert align("a b c".split(), "a x c d".split()) == (2, 1, 0, 1)
    assert align([], ["a"]) == (0, 0, 0, 1) and align(["a"], []) == (0, 0, 1, 0)
    assert common_order(list("abcd"), list("xbxd")) == 2
    df = spark.createDataFrame([(1, ["a", "b"], ["a"]), (2, [], [])], "k int, r array<string>, o array<string>")
    got = {r.k: (r.matches, r.omissions, r.in_order) for r in token_alignment(df, "k", "r", "o").collect()}
    assert got == {1: (1, 1, 1), 2: (0, 0, 0)}


def test_exact_bounds(spark):
    assert upper_bounds([0, 5], [0, 5]).tolist() == [1.0, 1.0] and len(upper_bounds([], [])) == 0
    assert abs(upper_bounds([0], [59])[0] - (1 - 0.05 ** (1 / 59))) < 1e-9
    for k, n in ((1, 30), (4, 20), (10, 1_000), (300, 700)):  # at the bound, k or fewer cases have the probability alpha
        u = float(upper_bounds([k], [n])[0])
        assert abs(sum(math.comb(n, i) * u**i * (1 - u) ** (n - i) for i in range(k + 1)) - 0.05) < 1e-9
    assert abs(spark.range(1).select(bound_column(F.lit(1), F.lit(30)).alias("b")).first().b - upper_bounds([1], [30])[0]) < 1e-12
    assert tile_offsets(10, 20, 2) == [0] and tile_offsets(25, 10, 2)[-1] == 15


def test_transliteration_and_phrases(spark):
    assert one(spark, T.to_cyrillic("t"), "Shchukin Zhora") == "щукин жора" and one(spark, T.to_cyrillic("t"), "Deutsch, Ye-Sergij 3") == "деуцч, е-сергий 3"
    assert one(spark, T.drop_repeated_lead("t"), "Monte Alto Monte Alto 1944") == "Monte Alto 1944"
    assert one(spark, T.drop_repeated_lead("t"), "Monte Montealto") == "Monte Montealto"
    assert one(spark, T.dates_compatible("t", F.lit("1944-05-01")), "1944-05") and not one(spark, T.dates_compatible("t", F.lit("1944-05")), "1945")
