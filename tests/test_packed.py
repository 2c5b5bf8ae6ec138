"""Links packed in one field: the vectorised splitter against the sequential one, and the cases by hand."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinflow.operators.packed import split_batch, split_one, unpack_links
from tests.conftest import rows

CASES = [
    (None, []),
    ("", []),
    (" ,, ;", []),
    ("[]", []),
    ("no links here", []),
    ("http://a.x/b", ["http://a.x/b"]),
    ("http://a.x/?a=1,2&b=3, /c | https://d.x/;;", ["http://a.x/?a=1,2&b=3", "/c", "https://d.x/"]),
    ("https://a.x/~b/c~https://d.x/", ["https://a.x/~b/c", "https://d.x/"]),
    ("\"https://a.x/say?x=\"\"q\"\"&y=1\"\t'/b'", ['https://a.x/say?x="q"&y=1', "/b"]),
    ('"https://a.x/a b/c", "", /d', ["https://a.x/a b/c", "/d"]),
    ('["https:\\/\\/a.x\\/b", "\\/c"]', ["https://a.x/b", "/c"]),
    ("[/a, https://b.x/]", ["/a", "https://b.x/"]),
    ("/a||/a^/b\n/c", ["/a", "/a", "/b", "/c"]),
    ("\"/a,/b';/c\" '/d\"e'", ["/a,/b';/c", '/d"e']),
    ('"/unclosed, /b', ["/unclosed", "/b"]),
    ('["/a\\u00e9", "/\\\\b"]', ["/aé", "/\\b"]),
]


@pytest.mark.parametrize("text,links", CASES)
def test_cases(text, links):
    assert split_one(text) == links
    parents, got = split_batch(pa.array([None, text, "/x"], pa.string()))
    assert got.to_pylist() == [*links, "/x"]
    assert parents.tolist() == [1] * len(links) + [2]


PARTS = ["http://a.b/c", "https://x/", "/q", '"', "'", ",", ";", "|", " ", "\t", "~", "^", "[", "]", "\\", "\\/", '""', "a b", "h", "é"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=10).map("".join)), max_size=8))
def test_same_as_sequential(texts):
    parents, links = split_batch(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for p, x in zip(parents.tolist(), links.to_pylist(), strict=True):
        got[p].append(x)
    assert got == [split_one(t) for t in texts]


def test_slices_of_arrays():
    whole = pa.array(["/a,/b", None, "/c", "'/d'"])
    assert split_batch(whole.slice(2))[1].to_pylist() == ["/c", "/d"]
    assert split_batch(whole.slice(1, 1))[1].to_pylist() == []


def test_operator(spark):
    data = [(1, "/a,/b", 7), (1, "/a,/b", 7), (2, None, 8), (3, "", 9), (4, "/x" * 50_000 + ",/y", 1), (None, "/n", 2)]
    df = spark.createDataFrame(data, "seq long, url string, pos int")
    got = rows(unpack_links(df))
    assert got == [(None, 1, "/n"), (1, 1, "/a"), (1, 2, "/b"), (4, 1, "/x" * 50_000), (4, 2, "/y")]
    assert rows(unpack_links(df.limit(0))) == []


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/pageranks_temp.parquet")
    fields = {r["seq"]: r["url"] for r in table.collect()}
    want = sorted((s, i, x) for s, u in fields.items() for i, x in enumerate(split_one(u), 1))
    assert rows(unpack_links(table)) == want
