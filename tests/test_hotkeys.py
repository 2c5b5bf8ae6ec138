"""Per-key results against brute force, with one key that holds most rows."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from skeinflow.operators.hotkeys import body_results, heavy, key_results, link_results, with_first_url
from skeinflow.operators.packed import split_one
from tests.conftest import rows


def test_key_results(spark):
    data = [("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)]
    df = spark.createDataFrame(data, "k string, i long").repartition(7)
    got = {r["key_value"]: (r["n"], r["first"]) for r in key_results(df, "k", "i").collect()}
    assert got["hot"] == (900, 0) and got["k7"] == (1, 7) and None not in got and len(got) == 51
    assert rows(heavy(key_results(df, "k", "i"), 2)) == [("hot", 900, 0)]
    assert rows(heavy(key_results(df.limit(0), "k", "i"), 2)) == []


def test_share_is_exact(spark):
    df = spark.range(100).select(F.when(F.col("id") < 2, "two").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    assert rows(heavy(key_results(df, "k", "id"), 2)) == [("two", 2, 0)]
    assert rows(heavy(key_results(df, "k", "id"), 3)) == []


def test_no_plan_gathers_rows_of_a_key(spark):
    df = spark.range(10).select(F.lit("x").alias("k"), "id")
    plan = key_results(df, "k", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "collect_list" not in plan


def test_tables(spark, sf):
    crawl, state = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("crawl", "pageranks_temp"))
    pages = {r["page_id"]: (r["page"], r["url"]) for r in crawl.collect() if r["page"] is not None}
    bodies = defaultdict(list)
    for i, (page, _) in pages.items():
        bodies[hashlib.md5(page.encode()).hexdigest()].append(i)
    want = sorted((k, len(v), pages[min(v)][1]) for k, v in bodies.items())
    assert rows(with_first_url(body_results(crawl), crawl, "page_id", "url")) == want
    links = Counter(x for u in {r["seq"]: r["url"] for r in state.collect()}.values() for x in split_one(u))
    assert {r["key_value"]: r["n"] for r in link_results(state).collect()} == dict(links)
    total = sum(links.values())
    assert {r["key_value"] for r in heavy(link_results(state), 2).collect()} == {k for k, n in links.items() if n * 50 >= total}


def test_second_deliveries_and_nulls(spark):
    data = [(1, "u", "body"), (1, "u", "body"), (2, "v", "body"), (3, "w", None), (4, "x", "")]
    crawl = spark.createDataFrame(data, "page_id long, url string, page string")
    got = rows(with_first_url(body_results(crawl), crawl, "page_id", "url"))
    assert [(n, u) for _, n, u in got] == [(2, "u"), (1, "x")] or [(n, u) for _, n, u in got] == [(1, "x"), (2, "u")]
