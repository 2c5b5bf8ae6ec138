"""Bags, pairs and keyed tables: nulls, empty inputs, ties, repeats, Python functions."""

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import keyed as K
from skeinflow.operators import ranking as R
from skeinflow.operators.collections import Bag, Context, Pairs
from tests.conftest import rows


@pytest.fixture
def bag(spark):
    return Context(spark).parallelize(["b", "a", "b", "c"])


@pytest.fixture
def pairs(spark):
    return Pairs(spark.createDataFrame([("x", "2"), ("x", "1"), ("y", "3")], "k string, v string"))


def test_bag_calls(bag):
    assert sorted(bag.collect()) == ["a", "b", "b", "c"]
    assert bag.count().first()[0] == 4
    assert sorted(bag.distinct().collect()) == ["a", "b", "c"]
    assert bag.flat_map(lambda v: [] if v == "c" else None if v == "a" else [v, v], python=True).count().first()[0] == 4
    assert rows(bag.map_to_pair(lambda v: None if v == "c" else (v, v + v), python=True).df) == [("a", "aa"), ("b", "bb"), ("b", "bb")]
    assert rows(bag.flat_map_to_pair(lambda v: [(v, "1"), (v, "2")], python=True).df)[:2] == [("a", "1"), ("a", "2")]
    assert bag.filter(lambda v: v == "b", python=True).collect() == ["b", "b"]
    assert len(bag.map_partitions(lambda vs: [*vs, "end"]).collect()) >= 5
    assert bag.take(0).count() == 0 and bag.take(9).count() == 4
    assert sorted(bag.intersection(Bag(bag.df.where("value <> 'a'"))).collect()) == ["b", "c"]
    assert sorted(bag.difference(Bag(bag.df.where("value <> 'a'"))).collect()) == ["a"]
    assert rows(bag.group_by(lambda v: F.when(v == "b", "B").otherwise("other")).df) == [("B", "b,b"), ("other", "a,c")]
    assert bag.sample(0.0).count().first()[0] == 0 and bag.sample(1.0).count().first()[0] == 4


def test_folds(bag, spark):
    assert bag.fold("", lambda a, b: max(a, b)).first()[0] == "c"
    assert bag.fold("zero", aggregate=F.max("value")).first()[0] == "c"
    empty = Bag(bag.df.limit(0))
    assert empty.fold("zero", lambda a, b: a + b).first()[0] == "zero"
    assert empty.fold("zero", aggregate=F.max("value")).first()[0] == "zero"
    assert empty.distinct().collect() == [] and empty.count().first()[0] == 0


def test_pair_calls(pairs, spark):
    other = Pairs(spark.createDataFrame([("x", "9"), ("z", "8")], "k string, v string"))
    assert rows(pairs.join(other).df) == [("x", "1,9"), ("x", "2,9")]
    assert rows(pairs.cogroup(other).df) == [("x", "[1,2],[9]"), ("y", "[3],[]"), ("z", "[],[8]")]
    assert rows(pairs.fold_by_key(F.sum(F.col("value").cast("int"))).df) == [("x", "3"), ("y", "3")]
    assert pairs.count_pairs().first()[0] == 3 and pairs.count_keys().first()[0] == 2
    assert sorted(pairs.flat_map(lambda k, v: [k + v], python=True).collect()) == ["x1", "x2", "y3"]
    assert rows(pairs.flat_map_to_pair(lambda k, v: [(v, k)], python=True).df) == [("1", "x"), ("2", "x"), ("3", "y")]


def test_context(spark, bag):
    job = Context(spark)
    assert job.said() == "no output"
    job.output("a")
    job.output("b")
    assert job.said() == "ab"
    assert sorted(job.from_table(bag.df, F.when(F.col("value") != "b", F.col("value"))).collect()) == ["a", "c"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    job.set_concurrency_level(3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_store(spark, tmp_path):
    store = K.Store(spark, str(tmp_path), prefix="t_")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "key int, v string")
    store.put_table("one", df)
    assert store.has("one") and store.scan("two") is None
    assert rows(store.scan("one", 2, 3)) == [(2, "b"), (2, "b")]
    assert rows(store.described()) == [("one", 2, False)]
    assert store.rename("one", "two") and not store.rename("one", "three") and store.tables() == ["two"]
    assert store.persist("two") and not store.persist("two") and rows(store.described()) == [("two", 2, True)]
    store.put_table("three", spark.createDataFrame([(2, "x"), (3, "y")], "key int, v string"))
    store.copy("two", "three")
    assert rows(store.scan("three")) == [(1, "a"), (2, "b"), (2, "b"), (3, "y")]
    assert store.delete("two") and not store.delete("two")
    with pytest.raises(ValueError):
        store.put_table("a b", df)


def test_last_writes(spark):
    w = spark.createDataFrame([("r", "c", "1", 1), ("r", "c", "2", 2), ("r", "c", "3", 2), ("r", "d", None, 5), ("s", "c", "9", 1)], "key string, col string, value string, seq long")
    assert rows(K.last_writes(w)) == [("r", "c", "3"), ("r", "d", None), ("s", "c", "9")]
    assert rows(K.wide(w, ["c", "e"])) == [("r", "3", None), ("s", "9", None)]
    assert rows(K.last_writes(w.limit(0))) == []


def test_pages_of_a_view(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "v") for i in range(25)], "key int, v string")
    assert [r["key"] for r in K.viewed_page(df, 2).collect()] == ["20", "21", "22", "23", "24"]
    assert K.viewed_page(df, 1).first()["v"] == "v" and K.viewed_page(df, 3).count() == 0


def test_ranking(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", None), ("d", 5.0)], "url string, score double")
    assert [(r["rank"], r["url"]) for r in R.ranked(df, 3).collect()] == [(1, "d"), (2, "a"), (3, "b")]
    assert [r["place"] for r in R.tied_groups(df, 4).collect()] == [1, 2, 2, 3]
    assert [r["score"] for r in R.top_distinct_scores(df, 9).collect()] == [5.0, 2.0]
    freq = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 3)], "url string, n long")
    assert sorted(r["url"] for r in R.threshold_set(freq, 2).collect()) == ["b", "c", "d"]
    assert R.threshold_set(freq, 9).count() == 4 and R.threshold_set(freq.limit(0), 2).count() == 0


def test_python_folds_run_where_the_rows_are(spark):
    """Partials are made in as many tasks as there are partitions, and zero is used once whatever their number."""
    many = Bag(spark.range(0, 1000, 1, 8).select(F.format_string("%04d", "id")))
    assert many.fold("0", lambda n, _: str(int(n) + 1), combine=lambda a, b: str(int(a) + int(b))).first()[0] == "1000"
    for parts in (1, 3, 8):
        assert many.__class__(many.df.repartition(parts)).fold("zz|", lambda a, b: max(a, b)).first()[0] == "zz|"
        assert len(Bag(many.df.repartition(parts)).fold(">", lambda a, b: a + b).first()[0]) == 4001
    from skeinflow.operators.collections import _folded

    tasks = _folded(many.df.select(F.lit("").alias("key"), "value"), "", lambda a, b: max(a, b), None)
    assert tasks.select(F.spark_partition_id()).distinct().count() == 8


def test_fold_by_key_by_a_function(spark, monkeypatch):
    from skeinflow.operators import collections as C

    df = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"), F.col("id").cast("string").alias("value"))
    want = {r["key"]: str(r["n"]) for r in df.groupBy("key").agg(F.sum(F.col("value").cast("long")).alias("n")).collect()}
    add = lambda a, b: str(int(a) + int(b))
    assert dict(Pairs(df).fold_by_key("0", add, python=True).collect()) == want
    monkeypatch.setattr(C, "KEYS_HELD", 5)
    assert dict(Pairs(df).fold_by_key("0", add, combine=add, python=True).collect()) == want
    odd = Pairs(spark.createDataFrame([(None, "1"), (None, None), ("a", None), ("", "2")], "key string, value string"))
    assert rows(odd.fold_by_key("<", lambda a, v: a + str(v), python=True).df)[1:] == [("", "<2"), ("a", "<None")]
    assert odd.fold_by_key("<", lambda a, v: a + str(v), python=True).count_pairs().first()[0] == 3
    assert Pairs(df.limit(0)).fold_by_key("0", add, python=True).collect() == []


def test_python_forms(spark, bag):
    assert rows(bag.group_by(lambda v: "B" if v == "b" else "other", python=True).df) == [("B", "b,b"), ("other", "a,c")]
    df = spark.createDataFrame([(1, "x"), (2, None)], "n int, s string")
    assert Context(spark).from_table(df, lambda r: None if r["s"] is None else f"{r['n']}{r['s']}", python=True).collect() == ["1x"]
    assert sorted(bag.hash_sample(1.0).collect()) == ["a", "b", "b", "c"] and bag.hash_sample(0.0).collect() == []
    many = Bag(spark.range(10_000).select(F.col("id").cast("string")))
    some = many.hash_sample(0.2, 5)
    assert 1800 < some.count().first()[0] < 2200 and sorted(some.collect()) == sorted(Bag(many.df.repartition(7)).hash_sample(0.2, 5).collect())


@pytest.mark.parametrize("most", [1000, 2])
def test_patterns(spark, monkeypatch, most):
    """Few patterns as conditions, many by their rarest run: the same rows, each once."""
    monkeypatch.setattr(K, "MOST_LISTED", most)
    urls = ["http://a.example/x", "http://b.example/private/1", "http://a.example/x", None, "ab", "http://c.example/a_b%c", "http://c.example/aXbYc", ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    p = spark.createDataFrame([("http://a.example/%",), ("%/private/%",), ("%.example/private/%",), ("a%b",), (None,), (r"%a\_b\%c",), ("%zzzz%",), ("%zzzz%",)], "p string")
    assert rows(K.matching(df, "url", p, "p").select("id")) == [(0,), (1,), (2,), (4,), (5,)]
    assert K.matching(df, "url", p.limit(0), "p").count() == 0 and K.matching(df.limit(0), "url", p, "p").count() == 0


def test_page_of_cells(spark):
    w = spark.createDataFrame([(f"k{i:02}", c, str(i), i) for i in range(25) for c in (["a", "b"] if i % 2 else ["a", f"c{i}"])], "key string, col string, value string, seq long")
    page = K.viewed_cells(w, 2)
    assert page.columns == ["key", "a", "b", "c20", "c22", "c24"] and page.count() == 5
    assert [tuple(r) for r in page.orderBy("key").collect()][:2] == [("k20", "20", "", "20", "", ""), ("k21", "21", "21", "", "", "")]
    assert K.viewed_cells(w, 3).count() == 0


def test_crawl_operators(spark):
    from skeinflow.operators import crawling as C

    text = "User-agent: A\r\nUser-agent: *\nDisallow: /x\nCrawl-delay: 2\n\nUser-agent: Bot\nAllow: /y\nDisallow: \ncrawl-delay: soon\nUser-agent: c\nDisallow: /z"
    files = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Disallow: /lost")], "id int, text string")
    assert rows(C.robots_rules(files, "id", "text")) == [(1, "*", "crawl-delay", None, 2.0), (1, "*", "disallow", "/x", None)]
    assert rows(C.robots_rules(files, "id", "text", ["BOT"])) == [(1, "bot", "allow", "/y", None), (1, "bot", "crawl-delay", None, None), (1, "bot", "disallow", "", None)]
    pages = spark.createDataFrame([(1, "h", "/x/1"), (2, "h", "/y"), (3, "g", "/x"), (4, "h", "/q/a.pdf"), (5, None, "/x")], "id int, host string, path string")
    rules = spark.createDataFrame([("h", "/x"), ("h", "/x/"), ("h", "/*.pdf"), ("h", ""), ("z", "/"), ("h", None)], "host string, route string")
    assert rows(C.forbidden(pages, rules).select("id")) == [(1,), (4,)]
    seen = spark.createDataFrame([(1, "u", "same", 5), (2, "v", "same", 3), (3, "w", "other", 1), (2, "v", "same", 3), (4, "x", None, 1)], "page_id int, url string, page string, at int")
    assert rows(C.seen_before(seen, F.col("page"), ["at", "page_id"])) == [(1, "v")]
    for df in (files, pages, seen):
        empty = df.limit(0)
        assert (C.robots_rules(empty, "id", "text") if df is files else C.forbidden(empty, rules) if df is pages else C.seen_before(empty, F.col("page"), ["at", "page_id"])).count() == 0
