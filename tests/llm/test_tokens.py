"""Encoding against the reference implementation of the vocabulary, mixing, splitting."""

import base64
import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinflow.llm import mix, pieces, tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codec():
    return tokens.worker_codec(tokens._model_file(tokens.VOCABULARY))


@pytest.fixture(scope="module")
def other():
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("other", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


CASES = ["", " ", "Hello  world\n\n  x", "<|endoftext|>", "naïve café 東京 한국 🙂", "a" * 3000, "\x00\x01\ufeff", "▁ Ġ", "I'll we've 123456", "\r\n\t\u00a0"]


@pytest.mark.parametrize("text", CASES)
def test_ids(codec, other, text):
    ids = codec.encode(text)
    assert ids.tolist() == other.encode_ordinary(text)
    assert codec.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_many(texts):
    codec = tokens.worker_codec(tokens._model_file(tokens.VOCABULARY))
    ids, off = codec.encode_many(texts)
    for i, t in enumerate(texts):
        assert codec.decode(ids[off[i] : off[i + 1]]) == t


def test_whole_table(spark, sf, other):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(docs).collect()}
    assert got == {i: other.encode_ordinary(t) if t else [] for i, t in text.items()}


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0)], "doc_id long, text string, ids int")
    got = [(r["doc_id"], len(r["ids"])) for r in tokens.encode(df).collect()]
    assert sorted(got) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert tokens.encode(df.limit(0)).count() == 0
    assert sorted(r["text"] for r in tokens.decode(tokens.encode(df)).collect()) == ["", "", "a b", "a b"]
    assert sorted(r["n_tokens"] for r in tokens.count_tokens(df.select("doc_id", "text")).collect()) == [0, 0, 2, 2]


# ---------------------------------------------------------------- mixing


@pytest.mark.parametrize("mean,cap", [(0.0, 1), (0.3, 1), (1.0, 4), (2.5, 8), (800.0, 3)])
def test_thresholds(mean, cap):
    got = mix.thresholds(mean, cap)
    p = [math.exp(-mean) * mean**k / math.factorial(k) for k in range(cap)]
    for k, t in enumerate(got):
        assert t / mix.BINS == pytest.approx(1.0 if mean == 0 else sum(p[: k + 1]), abs=2 / mix.BINS)


def test_goals():
    tokens_, share, cap = {"a": 1000, "b": 100, "c": 10}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 4}
    free = mix.goals(tokens_, share, cap, None)
    assert free == pytest.approx({"a": 100, "b": 60, "c": 40})
    sized = mix.goals(tokens_, share, cap, 500)
    assert sized["c"] == 40 and sized["b"] == pytest.approx(460 * 0.3 / 0.8) and sum(sized.values()) == pytest.approx(500)
    over = mix.goals(tokens_, share, cap, 10_000)
    assert over == {"a": 1000, "b": 200, "c": 40}
    assert mix.goals({}, share, cap, None) == {"a": 0, "b": 0, "c": 0}


def test_fit_is_near(codec):
    rng = np.random.default_rng(1)
    bins = np.bincount(rng.integers(0, mix.BINS, 500), weights=rng.integers(1, 400, 500), minlength=mix.BINS).astype(np.int64)
    for share in (0.1, 0.5, 1.7, 2.9):
        goal = bins.sum() * share
        turn, cuts = mix.fit_source(bins, goal, 3)
        assert sum(np.roll(bins, turn)[c:].sum() for c in cuts) == pytest.approx(goal, rel=0.01)


@pytest.fixture(scope="module")
def mixed(spark, sf):
    docs, targets = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "mix_targets"))
    got, report = mix.mix(docs, targets)
    return docs, targets, got, report


def test_report_holds_for_the_mix(mixed):
    docs, targets, got, report = mixed
    codec = tokens.worker_codec(tokens._model_file(tokens.VOCABULARY))
    cap = {r["source"]: r["max_repeats"] for r in targets.collect()}
    lines = {r["source"]: r for r in report.collect()}
    assert lines.keys() == cap.keys()
    size, most = {}, {}
    for r in got.collect():
        size[r["source"]] = size.get(r["source"], 0) + len(codec.encode(r["text"]))
        most[r["source"]] = max(most.get(r["source"], 0), r["copy"])
    for s, line in lines.items():
        assert line["tokens"] == size.get(s, 0)
        assert line["repeats"] <= cap[s] and most.get(s, 0) <= cap[s]
        assert line["actual_share"] == pytest.approx(size.get(s, 0) / sum(size.values()))


def test_mix_is_the_same_again(mixed):
    docs, targets, got, _ = mixed
    again, _ = mix.mix(docs.repartition(5), targets)
    key = lambda df: sorted((r["doc_id"], r["copy"]) for r in df.collect())
    assert key(got) == key(again)


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "X-y ", 1), (2, None, "x_y", 1), (3, "c", None, 1), (4, "d", "other", 1), (5, "", " X_Y", 1)], "doc_id long, text string, source string, copy int")
    targets = spark.createDataFrame([("x_y", 1.0, 2), ("none", 0.5, 3)], "source string, target_share double, max_repeats int")
    got, report = mix.mix(docs, targets)
    assert {(r["doc_id"], r["copy"]) for r in got.collect()} == {(i, c) for i in (1, 2, 5) for c in (1, 2)}
    by = {r["source"]: r for r in report.collect()}
    assert by["x_y"]["repeats"] == 2.0 and by["x_y"]["actual_share"] == 1.0 and by["none"]["tokens"] == 0
    for a, b in ((docs.limit(0), targets), (docs, targets.limit(0))):
        got, report = mix.mix(a, b)
        assert got.count() == 0 and report.count() == b.count()


# ---------------------------------------------------------------- splitting


def check(codec, text, limit, overlap):
    """Pieces hold the limit unless they are one character, their cores are the text, and starts ascend."""
    spans = pieces.split_spans(codec, text, codec.encode(text), limit, overlap)
    assert [n for *_, n in spans] == [len(codec.encode(text[a:b])) for a, _, b, _ in spans]
    spans = [x[:3] for x in spans]
    parts = [text[a:b] for a, _, b in spans]
    assert parts == pieces.split_document(codec, text, codec.encode(text), limit, overlap)
    assert all(len(codec.encode(p)) <= limit or len(p) == 1 for p in parts)
    assert "".join(text[m:b] for _, m, b in spans) == text and all(a <= m < b for a, m, b in spans)
    return parts, spans


@pytest.mark.parametrize("limit,overlap", [(16, 0), (16, 4), (40, 10), (5, 2)])
def test_pieces(codec, limit, overlap):
    text = "\n\n".join(" ".join(f"Sentence {i} of paragraph {j} stands here." for i in range(6)) for j in range(8))
    check(codec, text, limit, overlap)


def test_cuts_are_natural(codec):
    text = "".join(f"Paragraph {i} has one sentence. And it has another.\n\n" for i in range(40))
    parts, _ = check(codec, text, 64, 0)
    assert all(p.endswith("\n\n") for p in parts)
    one = " ".join(f"This is sentence number {i} of a long line." for i in range(60))
    assert all(p.endswith(".") for p in check(codec, one, 64, 0)[0])


def test_overlap(codec):
    text = " ".join(f"This is sentence number {i} of a long line." for i in range(60))
    _, spans = check(codec, text, 64, 12)
    assert all(len(codec.encode(text[a:m])) == 12 for a, m, _ in spans[1:])


@pytest.mark.parametrize("text", ["x" * 500, "東京都" * 200, "🙂" * 60, "a\r\nb\r\n" * 90, " " * 300, "é" * 200], ids=list("abcdef"))
def test_hard_texts(codec, text):
    check(codec, text, 20, 5)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n é東", min_size=30, max_size=200), st.integers(4, 12), st.integers(0, 3))
def test_any_text(text, limit, overlap):
    check(tokens.worker_codec(tokens._model_file(tokens.VOCABULARY)), text, limit, overlap)


def test_split_operator(spark):
    docs = spark.createDataFrame([(1, "word " * 50, "A-b"), (2, None, "a_b"), (3, "", None), (4, "word " * 50, None), (5, "short", "a_b"), (6, "word " * 50, "else")], "doc_id long, text string, source string")
    limits = spark.createDataFrame([("a_b", 20, 5), ("*", 1000, 0)], "source string, max_tokens int, overlap_tokens int")
    got = pieces.split_oversized(docs, limits).collect()
    assert {r["doc_id"] for r in got} == {1}
    assert sorted(r["number"] for r in got) == list(range(1, len(got) + 1)) and max(r["n_tokens"] for r in got) <= 20
    assert pieces.split_oversized(docs.limit(0), limits).count() == 0
    assert pieces.split_oversized(docs, limits.limit(0)).count() == 0


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" + "." * 1_000_000 + "b", "a\n" * 300_000, "! " * 300_000])
def test_boundaries_of_a_million_signs(text):
    began = time.perf_counter()
    assert len(pieces.boundary_strengths(text)) == len(text) + 1
    assert time.perf_counter() - began < 1


def test_boundary_strengths():
    text = "ab. cd\n  ef \r\n\r\n gh\n"
    got = pieces.boundary_strengths(text).tolist()
    assert got == [0, 0, 0, 3, 3, 0, 2, 4, 0, 4, 0, 2, 0, 0, 0, 0, 5, 5, 0, 2, 4]
    assert pieces.boundary_strengths("").tolist() == [0]


def test_thresholds_by_a_join(spark, sf, monkeypatch):
    """More sources than are sent to all workers give the same mix, in one order over all partitions."""
    docs, targets = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "mix_targets"))
    one, report = mix.mix(docs, targets)
    monkeypatch.setattr(mix, "MOST_SENT", 2)
    other, again = mix.mix(docs, targets)
    assert [(r["doc_id"], r["copy"]) for r in one.collect()] == [(r["doc_id"], r["copy"]) for r in other.collect()]
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, again.collect()))
    from pyspark.sql import functions as F

    order = [r["o"] for r in one.select(F.xxhash64("doc_id", "copy", F.lit(mix.SEED + 1)).alias("o")).collect()]
    assert order == sorted(order) and len(order) > 1


def test_many_sources(spark):
    docs = spark.createDataFrame([(i, f"s-{i % 3000}", "a few words") for i in range(6000)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([(f"S_{i}", 1 / 3000, 2) for i in range(3000)], "source string, target_share double, max_repeats int")
    got, report = mix.mix(docs, targets)
    assert report.count() == 3000 and got.count() == report.agg({"documents": "sum"}).first()[0] > 6000


def test_counts_equal_encodings(codec, monkeypatch):
    """With words forgotten between, long ones, repeats, and empty texts."""
    texts = ["a few words, a few more", None, "", "x" * 5000 + " end", "日本語 text 123 \n\n tail ", "a few words"] * 3
    want = np.diff(codec.encode_many(texts)[1]).tolist()
    assert codec.count_many(texts).tolist() == want
    monkeypatch.setattr(tokens, "MOST_KEPT", 3)
    assert codec.count_many(texts).tolist() == want and codec.count_many(["other words", *texts]).tolist()[1:] == want
    assert codec.count_many([]).tolist() == []
