"""PageRank, crawl replay and search on graphs small enough to work out."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinflow.functions import words as W
from skeinflow.plans import graph as G
from skeinflow.plans import search as S


def by_hand(nodes, edges, rounds):
    rank = dict.fromkeys(nodes, 1.0)
    for _ in range(rounds):
        new = dict.fromkeys(nodes, 0.15)
        for n in nodes:
            out = [b for a, b in edges if a == n and b in rank]
            for b in out:
                new[b] += 0.85 * rank[n] / len(out)
        rank = new
    return rank


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_ranks(spark, rounds):
    nodes, edges = "abcd", [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "x"), ("d", "d")]
    v = spark.createDataFrame([(n,) for n in nodes], "id string")
    e = spark.createDataFrame(edges, "src string, dst string")
    got = {r["id"]: r["rank1"] for r in G.pagerank(v, e, rounds=rounds).collect()}
    assert got == pytest.approx(by_hand(nodes, edges, rounds))


def test_spread_sources(spark):
    """A source with most edges is in many parts, and the ranks stay the same; rounds don't shuffle edges."""
    nodes = [f"n{i}" for i in range(60)]
    edges = [("n0", n) for n in nodes[1:]] + [("n1", "n0"), ("n2", "n0"), ("n3", "n4")]
    v = spark.createDataFrame([(n,) for n in nodes], "id string")
    e = spark.createDataFrame(edges, "src string, dst string")
    got = {r["id"]: r["rank1"] for r in G.pagerank(v, e, rounds=3, hot_source=5).collect()}
    assert got == pytest.approx(by_hand(nodes, edges, 3))
    spread = G.SpreadEdges(G.inner_edges(e, v), 5)
    assert spread.hot == ["n0"] and spread.edges.select("part").distinct().count() > 10
    ranks = G.written(G.start_ranks(v))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = G.rank_round(ranks, spread)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SelectedBucketsCount" in plan and plan.count("Exchange hashpartitioning") <= 3


def test_convergence_stops(spark):
    v = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    ranks = G.pagerank(v, e)
    assert G.converged(ranks, 0.01) == (2, 2)
    assert {r["rank1"] for r in ranks.collect()} == {1.0}
    assert G.pagerank(v.limit(0), e.limit(0), rounds=2).count() == 0


def test_crawl_replay(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), (None,), ("a",)], "url string")
    assert {r["url"]: r["depth"] for r in G.crawl_order(e, seeds).collect()} == {"a": 0, "b": 1, "c": 2, "d": 2}


def test_query_words():
    assert S.query_words("The cats of the Harbour") == ["cat", "harbour"]
    assert S.query_words("of the") == ["of", "the"]
    assert S.query_words("") == []


def test_scores(spark):
    index = spark.createDataFrame([("cat", "u", 2), ("cat", "v", 1), ("dog", "u", 3)], "term string, url string, n int")
    got = {r["url"]: r["tf_idf"] for r in S.scored(index, ["cat", "dog"], F.lit(4.0), 2.0).collect()}
    assert got == pytest.approx({"u": (2 * math.log(2) + 3 * math.log(4)) / 2, "v": math.log(2) / 2})
    ranks = spark.createDataFrame([("u", 0.5)], "url string, pr double")
    best = {r["url"]: r["score"] for r in S.combined(S.scored(index, ["cat"], F.lit(4.0), 1.0), ranks, "weighted").collect()}
    assert best == pytest.approx({"u": 0.45 + 0.2 * math.log(2), "v": 0.1 * math.log(2)})


def test_spelling(spark):
    v = spark.createDataFrame([("harbour", 5), ("market", 9), ("marked", 3)], "term string, n long")
    w = spark.createDataFrame([("harbor",), ("market",), ("markt",), ("zzz",)], "word string")
    assert {r["word"]: r["suggestion"] for r in S.spelling(w, v).collect()} == {"harbor": "harbour", "market": "market", "markt": "market", "zzz": None}


def test_postings(spark):
    pages = spark.createDataFrame([("u", "cats cat the http")], "url string, text string")
    got = sorted((r["term"], r["n"], r["positions"]) for r in S.postings(pages).collect())
    assert got == [("cat", 1, [1]), ("cat", 1, [2]), ("cats", 1, [1]), ("the", 1, [3])]
    assert {r["key"]: r["url"] for r in S.rendered(S.word_postings(pages)).collect()}["cat"] == "u^1 2"


def test_rounds_leave_one_table(spark):
    from pathlib import Path

    from skeinflow.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("ranks-*"))
    v = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    ranks = G.pagerank(v, e, rounds=5)
    assert len(set(folder.glob("ranks-*")) - before) == 1 and ranks.count() == 2


def test_whole_pages_are_indexed(spark, tmp_path):
    """Words past 10,000 characters and pages of addresses over 100 characters, where no limits are given."""
    from skeinflow.plans import registry

    long = "http://a.example/" + "p" * 120
    crawl = [(1, "http://a.example/x", "early " + "pad " * 3000 + "late", 1), (2, long, "early boat", 1)]
    spark.createDataFrame(crawl, "page_id long, url string, page string, fetched_at long").write.parquet(str(tmp_path / "crawl.parquet"))
    got = {(r["term"], r["url"]): r["positions"] for r in registry.QUERIES["q1_index"](spark, str(tmp_path)).collect()}
    assert got["late", crawl[0][1]] == [3005] and ("boat", long) in got
    assert "late" in {r["term"] for r in registry.QUERIES["f14_stems"](spark, str(tmp_path)).collect()}
    ranks = spark.createDataFrame([], "url string, pr double, computed_at long")
    ranks.write.parquet(str(tmp_path / "pageranks.parquet"))
    assert {r["url"] for r in S.search(spark, str(tmp_path), "late boats").collect()} == {crawl[0][1], long}
    limited = S.word_postings(S.indexed_pages(spark, str(tmp_path), limits=W.LIMITS), W.LIMITS)
    assert {r["url"] for r in limited.collect()} == {crawl[0][1]} and limited.where("term = 'late'").isEmpty()


def test_limits_of_rounds_are_errors(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {r["url"]: r["depth"] for r in G.crawl_order(e, seeds).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    v = spark.createDataFrame([(n,) for n in "abcd"], "id string")
    with pytest.raises(RuntimeError):
        G.pagerank(v, e, share=1.0, most=1, settle=True)


def test_long_chains_are_replayed_to_their_end(spark):
    """Over a hundred links deep, with the visited table cut many times, and with a way back to the seed."""
    chain = [f"n{i}" for i in range(130)]
    e = spark.createDataFrame([*zip(chain, chain[1:], strict=False), (chain[-1], "n0"), ("n3", "n1"), (None, "x"), ("n1", None)], "src string, dst string")
    seeds = spark.createDataFrame([("n0",)], "url string")
    got = {r["url"]: r["depth"] for r in G.crawl_order(e, seeds, every=25).collect()}
    assert got == {u: i for i, u in enumerate(chain)}
    assert G.crawl_order(e.limit(0), seeds).count() == 1 and G.crawl_order(e, seeds.limit(0)).count() == 0


CRAWL = [
    (1, "http://a.example/cats", "<title>Of cats</title> cats cat cats harbour", 1),
    (2, "http://a.example/dogs", "<title>Of <b>dogs</b></title> dogs and a cat", 2),
    (3, "http://b.example/none", "nothing here", 3),
    (4, "http://a.example/cats", "<title>Cats again</title> cat harbours harbour", 4),
]


@pytest.fixture
def site(spark, tmp_path):
    spark.createDataFrame(CRAWL, "page_id long, url string, page string, fetched_at long").write.parquet(str(tmp_path / "crawl.parquet"))
    ranks = [("http://a.example/dogs", 0.5, 1), ("http://a.example/dogs", None, 2)]
    spark.createDataFrame(ranks, "url string, pr double, computed_at long").write.parquet(str(tmp_path / "pageranks.parquet"))
    return str(tmp_path)


def test_answer(spark, site):
    import json

    got = json.loads(S.answer(spark, site, "The Cats").first()["json"])
    assert "spellcheck" not in got
    assert sorted((r["domain"], r["url"], r["title"]) for r in got["results"]) == [("a.example", "http://a.example/cats", "Cats again"), ("a.example", "http://a.example/dogs", "Of <b>dogs</b>")]
    got = json.loads(S.answer(spark, site, "the harbuor").first()["json"])
    assert got["spellcheck"] == ["the", "harbour"] and [r["url"] for r in got["results"]] == ["http://a.example/cats"]
    for nothing in ("", "zzzzzz", "the an"):
        assert json.loads(S.answer(spark, site, nothing).first()["json"])["results"] == []


def test_stems_are_asked_without_an_index(spark, site):
    """The postings of some stems equal those of the whole index."""
    pages = S.indexed_pages(spark, site)
    whole = S.postings(pages)
    for stems in (["cat"], ["cat", "harbour", "again"], ["dog", "th"], ["zz"]):
        want = sorted((r["term"], r["url"], r["n"], r["positions"]) for r in whole.where(F.col("term").isin(*stems)).collect())
        assert sorted((r["term"], r["url"], r["n"], r["positions"]) for r in S.stem_postings(pages, stems).collect()) == want
    assert S.stem_postings(pages, []).count() == 0


@given(st.lists(st.sampled_from("a e i o u y b l s t z ed ing ational ness eed ies sses ion ement ment ent ful ize ll enci logi bli x".split()), min_size=1, max_size=6))
def test_words_begin_with_their_stem_but_for_two_letters(parts):
    word = "".join(parts)
    found = W.stem(word)
    assert word.startswith(found[: max(1, len(found) - 2)])


def test_merged_index(spark):
    old = spark.createDataFrame([("cat", "u", 1, [1]), ("dog", "u", 1, [2]), ("cat", "v", 1, [1])], "term string, url string, n int, positions array<int>")
    new = spark.createDataFrame([("cow", "u", 1, [1])], "term string, url string, n int, positions array<int>")
    fetched = spark.createDataFrame([("u",), ("w",)], "url string")
    assert sorted((r["term"], r["url"]) for r in S.merged_postings(old, new, fetched).collect()) == [("cat", "v"), ("cow", "u")]


def test_subset(spark):
    index = spark.createDataFrame([("cat", f"u{i}", i) for i in range(1, 6)] + [("dog", "u5", 1)], "term string, url string, n int")
    hits, n = S.in_subset(index, ["cat", "dog"], 2)
    assert {r["url"] for r in hits.collect()} == {"u4", "u5"} and spark.range(1).select(n.alias("n")).first()["n"] == 2


@pytest.mark.parametrize("master,fine", [("local[4]", True), ("local", True), ("local-cluster[3,2,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_a_shared_folder_is_needed_on_a_cluster(master, fine):
    from types import SimpleNamespace

    from skeinflow import session

    unset = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(master=master, getConf=lambda: unset, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None)
    if fine:
        assert session.shared_folder(SimpleNamespace(conf=unset, sparkContext=context))
    else:
        with pytest.raises(RuntimeError):
            session.shared_folder(SimpleNamespace(conf=unset, sparkContext=context))
