"""Addresses, words and the stemmer: worked cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import urls as U
from skeinflow.functions import words as W

BASE, H = "https://foo.com:8000/bar/xyz.html", "http://H/foo/bar/pageName.html"
NORMAL = [
    (BASE, "#abc", None),
    (BASE, "blah.html#test", "https://foo.com:8000/bar/blah.html"),
    (BASE, "../blubb/123.html", "https://foo.com:8000/blubb/123.html"),
    (BASE, "/one/two.html", "https://foo.com:8000/one/two.html"),
    (BASE, "http://elsewhere.com/some.html", "http://elsewhere.com:80/some.html"),
    (H, "same-level.html", "http://H:80/foo/bar/same-level.html"),
    (H, "../one-level-up.html", "http://H:80/foo/one-level-up.html"),
    (H, "../../two-levels-up.html", "http://H:80/two-levels-up.html"),
    (H, "/root-direct.html", "http://H:80/root-direct.html"),
    (H, "/blah/root-subdir.html", "http://H:80/blah/root-subdir.html"),
    (H, "http://H/foo/bar/full-url.html", "http://H:80/foo/bar/full-url.html"),
    (H, "http://H/with-hash.html#something", "http://H:80/with-hash.html"),
    (H, "http://H:80/with-port.html", "http://H:80/with-port.html"),
    (H, "http://H/other-attr.html", "http://H:80/other-attr.html"),
    (H, "http://other/different-host.html", "http://other:80/different-host.html"),
    ("http://H/a/b/c/d/e/pageName.html", "../../../../b.html", "http://H:80/a/b.html"),
    (H, "mailto:someone@example.com", None),
    (None, "http://a/b", "http://a:80/b"),
    (H, None, None),
]


def one(spark, expr, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    df = spark.createDataFrame([values], schema)
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize("base,link,want", NORMAL)
def test_normal_form(spark, base, link, want):
    assert one(spark, U.normalized, base, link) == want


def test_parts(spark):
    assert tuple(one(spark, U.url_parts, "http://a.b:81/c?d")) == ("http", "a.b", "81", "/c?d")
    assert tuple(one(spark, U.url_parts, "https://a.b")) == ("https", "a.b", None, "/")
    assert tuple(one(spark, U.url_parts, "x/y")) == (None, None, None, "x/y")
    assert one(spark, lambda c: U.composed(U.url_parts(c)), "http://a.b:81/c?d") == "http://a.b:81/c?d"


def test_links(spark):
    page = '<a href="/a">x</a> <A HREF="/b.png">\nhref="/no"\n<a class="c" href="/c d"> <a href=\'/e\'>\n<a href="/a">'
    assert one(spark, U.page_links, page) == ["/a", "/c", "/a"]


def test_row_key(spark):
    def letters(b):
        n = 255 if b == 0 else b - 1 if b > 127 else b
        return chr(97 + n % 26) + chr(97 + n // 26 * 2)

    for text in ["", "0", "http://a/b", "é"]:
        assert one(spark, U.row_key, text) == "".join(map(letters, hashlib.sha1(text.encode()).digest()))


def test_language_filter(spark):
    assert one(spark, U.passes_language, "http://a.example/story") is True
    assert one(spark, U.passes_language, "http://a.example/de/story") is False
    assert one(spark, lambda c: U.passes_language(c, ["story"]), "http://a.example/story") is False


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("meetings", "meet"), ("matting", "mat"), ("milling", "mill"), ("mating", "mate"), ("agreed", "agre"), ("disabled", "disabl"), ("possibly", "possibl"), ("apology", "apolog"), ("sky", "sky"), ("by", "by"), ("", ""), ("generalizations", "gener"), ("rolling", "roll"), ("controlled", "control"), ("hopping", "hop"), ("filing", "file")])
def test_stems(word, want):
    assert W.stem(word) == want


def test_stems_of_a_column(spark):
    df = spark.createDataFrame([("cats",), ("cats",), (None,), ("",)], "term string")
    assert sorted(str(r["stem"]) for r in W.with_stems(df).collect()) == ["", "None", "cat", "cat"]


def test_words(spark):
    assert one(spark, lambda c: W.tokens(W.stripped(c)), "A <b class='x'>Big</b> page<br cut off") == ["a", "big", "page"]
    assert one(spark, lambda c: W.tokens(W.stripped(c)), "1 < 2 <i>x</i> < y") == ["1", "2", "x"]
    assert one(spark, W.trimmed_word, "(word!)") == "word"
    assert one(spark, W.trimmed_word, "...") == "."
    assert one(spark, lambda c: W.word_weight(W.tokens(c), True), "the old harbour") == pytest.approx(2.05)
    assert one(spark, lambda c: W.word_weight(W.tokens(c), False), "the old harbour") == 2.0
    assert one(spark, lambda c: W.all_stop_words(W.tokens(c)), "of the") is True


def test_positions(spark):
    df = spark.createDataFrame([("u", "b a b"), ("v", ""), ("w", None)], "url string, text string")
    assert sorted(tuple(r) for r in W.word_positions(df, "url", F.col("text")).collect()) == [("u", "a", 1, [2]), ("u", "b", 2, [1, 3])]


def test_like_pattern(spark):
    df = spark.createDataFrame([("*.zip", "a.zip", True), ("*.zip", "a.zip2", False), ("http*://x_y/*", "https://x_y/z", True), ("http*://x_y/*", "https://xay/z", False), ("a", "a", True)], "p string, u string, want boolean")
    checked = df.withColumn("p2", U.like_pattern(F.col("p"))).where(F.expr("(u like p2) <> want"))
    assert checked.count() == 0


def test_stemmer_equals_its_sql():
    """On words put together from endings, with y in all places, and on the samples of the tests above."""
    import random

    import duckdb

    from skeinflow.functions.words import stem
    from skeinflow.plans.stem_sql import stem_ctes

    rnd = random.Random(7)
    parts = "a e i o u y yy b l s t z x tr ed ing ational tional ness eed ies sses ss ion ement ment ent ful ize izer ll enci logi bli ical iviti ous 1 0x".split()
    words = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6))) for _ in range(4000)} | {"harbours", "described", "cats", "skies", "dying", "of", "y"})
    con = duckdb.connect()
    con.execute("create table v as select unnest(?) as word", [words])
    got = dict(con.sql(f"WITH {stem_ctes('v')} SELECT word, stem FROM stems").fetchall())
    assert got == {w: stem(w) for w in words}


def test_normal_form_as_described(spark):
    """Ports are the protocol's, and of dots only a leading .. is dropped."""
    from pyspark.sql import functions as F

    from skeinflow.functions import urls as U

    cases = [
        ("http://a.example:8000/x/y.html", "../z?q=1", "http://a.example:80/x/z?q=1"),
        ("https://a.example:8000/x/", "b/../c", "https://a.example:443/x/b/../c"),
        ("http://a.example/x", "https://b.example:99/q#top", "https://b.example:443/q"),
        ("http://a.example/x", "#top", None),
        ("http://a.example/x", "mailto:me", None),
        ("http://a.example/x", None, None),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "b string, l string")
    assert [r[0] for r in df.select(U.normalized(F.col("b"), F.col("l"), as_described=True)).collect()] == [c[2] for c in cases]
