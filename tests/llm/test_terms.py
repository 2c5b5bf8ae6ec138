"""Term counts and distinctive terms against brute force."""

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinflow.llm import registry, terms
from tests.conftest import rows
from tests.oracle import assert_same, connect


def words(page):
    return re.findall("[a-z0-9]+", re.sub(r"<[^<>]*(?:>|\Z)", " ", page or "").lower())


def brute_counts(pages, n):
    occurrences, texts = Counter(), defaultdict(set)
    for i, p in enumerate(pages):
        t = words(p)
        for k in range(len(t) - n + 1):
            g = " ".join(t[k : k + n])
            occurrences[g] += 1
            texts[g].add(i)
    return {g: (c, len(texts[g])) for g, c in occurrences.items()}


def counted(spark, pages, n):
    df = spark.createDataFrame([(p,) for p in pages], "page string")
    return {(r["n"], r["term"]): (r["occurrences"], r["pages"]) for r in terms.gram_counts(df, max_n=n).collect()}


PAGES = ["a b a <b>c</b> a b", "", None, "a b a <b>c</b> a b", "A-B_c x<y z", "İx K1 ẞ", "<a href='x", "one", "x " * 3000 + "<i>y</i>"]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_counts(spark, n):
    got = counted(spark, PAGES, n)
    assert got.pop((0, "")) == (sum(len(words(p)) for p in PAGES), len(PAGES))
    assert got == {(k, g): v for k in range(1, n + 1) for g, v in brute_counts(PAGES, k).items()}


def test_empty(spark):
    df = spark.createDataFrame([], "page string")
    assert terms.gram_counts(df).count() == 0
    assert terms.marked(terms.gram_counts(df)).count() == 0
    assert terms.distinctive_terms(spark.createDataFrame([], "page_id long, page string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 <>é\n", max_size=14)), max_size=6))
def test_coding(texts):
    text, code, names = terms.code_terms(pa.array(texts, pa.string()))
    got = defaultdict(list)
    for t, c in zip(text.tolist(), code.tolist(), strict=True):
        got[t].append(names[c].as_py())
    assert {i: words(t) for i, t in enumerate(texts) if words(t)} == dict(got)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=7), min_size=1, max_size=5), st.integers(1, 4))
def test_intervals(texts, max_n):
    t, c, names = terms.code_terms(pa.array([" ".join(x) for x in texts]))
    got = {}
    for n, first, count, pages in terms.suffix_intervals(t, c, max_n):
        for f, k, p in zip(first.tolist(), count.tolist(), pages.tolist(), strict=True):
            got[n, " ".join(names[x].as_py() for x in c[f : f + n].tolist())] = (k, p)
    want = {(n, g): v for n in range(1, max_n + 1) for g, v in brute_counts([" ".join(x) for x in texts], n).items()}
    assert got == want


def test_marks(spark):
    df = spark.createDataFrame([("a b",), ("a c",), ("a c",), ("d",), ("e f",)], "page string")
    assert {r["term"]: r["mark"] for r in terms.marked(terms.gram_counts(df)).collect()} == {"a": "common", "b": "rare", "c": None, "d": "rare", "e": "rare", "f": "rare"}
    assert {r["mark"] for r in terms.marked(terms.gram_counts(df.limit(1))).collect()} == {"rare"}


def brute_scores(pages, window):
    df = Counter(w for _, p in pages for w in set(words(p)))
    out = {}
    for i, p in pages:
        t = words(p)
        near = defaultdict(set)
        for a in range(len(t)):
            for b in range(a + 1, min(len(t), a + window)):
                near[t[a]].add(t[b])
                near[t[b]].add(t[a])
        for w, n in Counter(t).items():
            out[i, w] = (n, len(near[w]), df[w], len(near[w]) * math.log1p(len(pages) / df[w]))
    return out


@pytest.mark.parametrize("hot", [50_000, 3])
def test_scores(spark, monkeypatch, hot):
    monkeypatch.setattr(terms, "HOT_TERMS", hot)
    pages = list(enumerate(PAGES))
    df = spark.createDataFrame(pages, "page_id long, page string").repartition(3)
    got = {(r["page_id"], r["term"]): (r["tf"], r["degree"], r["pages"], r["score"]) for r in terms.distinctive_terms(df).collect()}
    want = brute_scores(pages, terms.WINDOW)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][:3] == v[:3] and got[k][3] == pytest.approx(v[3])


def test_limits_are_exact(spark):
    pages = list(enumerate(PAGES * 3))
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, page string, term string")
    some = {(r["page_id"], r["term"]): r["score"] for r in terms.distinctive_terms(df, min_tf=2, max_pages=6).collect()}
    every = brute_scores(pages, terms.WINDOW)
    assert some.keys() == {k for k, v in every.items() if v[0] >= 2 and v[2] <= 6}
    assert all(some[k] == pytest.approx(every[k][3]) for k in some)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, sf, name):
    assert_same(registry.QUERIES[name](spark, sf), connect(sf), registry.SQL[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_nothing_else_imports_it():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent.parent
    for f in [*(root / "skeinflow").rglob("*.py")]:
        if "llm" not in f.parts:
            assert "skeinflow.llm" not in f.read_text(), f


def test_p1_found_keeps_all_cases(spark, sf):
    """The score's floor loses no case."""
    pages = {r["page_id"]: r["page"] for r in spark.read.parquet(f"{sf}/crawl.parquet").collect() if r["page"] is not None}
    df = Counter(w for p in pages.values() for w in set(words(p)))
    want = sorted((i, w) for i, p in pages.items() for w, n in Counter(words(p)).items() if n >= 4 and df[w] <= 5)
    assert rows(registry.QUERIES["p1_found"](spark, sf)) == want


def test_p1_found_scores_all_terms(spark, sf, monkeypatch):
    from skeinflow.llm import queries

    asked, scores = [], terms.distinctive_terms

    def spy(*args, **limits):
        asked.append(limits)
        return scores(*args, **limits)

    monkeypatch.setattr(terms, "distinctive_terms", spy)
    queries.p1_found(spark, sf)
    assert asked == [{}]


def test_score_decides_the_keywords(spark):
    """A term used less often, but among more different terms, comes before a more frequent one; rare ones before common."""
    page = "alpha one alpha one alpha one " + " ".join(f"beta w{i} x{i}" for i in range(2)) + " the the"
    df = spark.createDataFrame([(1, page), (2, "the one"), (3, "the two"), (4, None), (5, "")], "page_id long, page string")
    got = [(r["page_id"], r["rank"], r["term"]) for r in terms.keywords(terms.distinctive_terms(df), 3).orderBy("page_id", "rank").collect()]
    by = {r["term"]: r for r in terms.distinctive_terms(df).where("page_id = 1").collect()}
    assert by["beta"]["tf"] < by["alpha"]["tf"] and by["beta"]["score"] > by["alpha"]["score"] > by["the"]["score"]
    assert [g[2] for g in got if g[0] == 1][0] == "beta" and [g[1] for g in got if g[0] == 1] == [1, 2, 3]
    assert [g[2] for g in got if g[0] == 2] == ["one", "the"] and not [g for g in got if g[0] in (4, 5)]
    assert terms.keywords(terms.distinctive_terms(df.limit(0))).count() == 0


def test_lengths(spark):
    df = spark.createDataFrame([(1, "a b a b c"), (2, "b a b")], "page_id long, page string")
    both = {(r["n"], r["term"]): (r["occurrences"], r["pages"]) for r in terms.gram_counts(df, max_n=3).collect()}
    assert both[3, "a b a"] == (1, 1) and both[2, "a b"] == (3, 2) and both[1, "b"] == (4, 2)
    one = {(r["n"], r["term"]): (r["occurrences"], r["pages"]) for r in terms.gram_counts(df, max_n=3, lengths=(1, 3)).collect()}
    assert one == {k: v for k, v in both.items() if k[0] != 2}
