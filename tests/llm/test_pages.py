"""Markup, main bodies and stuffed pages: cases by hand, minimum cuts against brute force."""

import itertools
import random
import re

import pyarrow as pa
import pytest

from skeinflow.llm import boilerplate as B
from skeinflow.llm import markup as M
from skeinflow.llm import stuffing as S
from skeinflow.llm.frames import Counts, repetition
from tests.conftest import rows


def as_in_a_collection(page, own, url="http://a.example/en/x", n=30):
    """The repetition of the page's lines among ``n`` pages of its site that have other words in the lines of ``own``."""
    rnd = random.Random(5)
    lines = page.split("\n")

    def word(m):
        return "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(1 + len(m.group()) // 2))

    others = ["\n".join(re.sub(r"(?<![</\w&])[A-Za-z]+(?![\w;]*>)", word, x) if k in own else x for k, x in enumerate(lines, 1)) for _ in range(n)]
    urls = [url] * (n + 1)
    counts = Counts.of([page, *others], urls)
    return repetition(pa.array([page]), pa.array([url]), counts)[0]

HTML = """<!DOCTYPE html>
<head><title>No heading - Site</title><style>h1 {x: 1}</style></head>
<body><nav><ul>
<li><a href="/a">Home &amp; more</a></li>
<LI>Help
</ul></nav>
<!-- <h2>hidden</h2> -->
<h1>The <b>big</b>&nbsp;<a href="/x">page</a></h1>
<p>Text $5 and $6 with \\(a &lt; b\\) and $$c
 d$$ and <code>\\(no\\)</code>.</p>
<h2 class="x">
Second
</h2>
<ul><li>one<ul><li>nested</li></ul> tail</li><li>two</ul>
<pre><code>if a &lt; b:
    <b>run</b>()   

</code></pre>
<table><tr><td>cell</td></tr></table><dl><dt>t</dt><dd>d</dd></dl>
<h3>cut off"""


def test_html():
    assert M.page_format(HTML) == "html"
    assert M.elements(HTML) == [
        ("list_item", "Home & more"),
        ("list_item", "Help"),
        ("heading", "The big page"),
        ("formula", "a < b"),
        ("formula", "c d"),
        ("heading", "Second"),
        ("list_item", "one tail"),
        ("list_item", "nested"),
        ("list_item", "two"),
        ("code", "if a < b:\n    run()"),
        ("heading", "cut off"),
    ]
    assert M.elements(HTML.replace("\n", "\r\n")) == M.elements(HTML)


MD = """# The *big* page #

Text with `# code` and $x_1 < y$, it costs $5 or $6, $ 7 in cash.

Under **lined**
---

* one [link](http://a/b_c_d)
* two\\_words
  go on
    - nested &amp; more
+ plus

1) first
2) second

```python
# not a heading
- not an item
```

    indented
      more

> quoted
> ## Inner

***

$$
\\frac{a}{b}
$$

| a | b |
|---|---|
| - x | $y$ |

<!-- ## hidden -->
"""


def test_markdown():
    assert M.page_format(MD) == "markdown"
    assert M.elements(MD) == [
        ("heading", "The big page"),
        ("formula", "x_1 < y"),
        ("heading", "Under lined"),
        ("list_item", "one link"),
        ("list_item", "two_words go on"),
        ("list_item", "nested & more"),
        ("list_item", "plus"),
        ("list_item", "first"),
        ("list_item", "second"),
        ("code", "# not a heading\n- not an item"),
        ("code", "indented\n  more"),
        ("heading", "Inner"),
        ("formula", "\\frac{a}{b}"),
    ]


WIKI = """{{Infobox x
| name = a
}}
'''Bold''' and [[Target|link]].<ref>* no</ref> {{cite|a}} <math>a \\le b</math>
== The ''big'' page ==
* one [http://a/b shown]
** [[nested]] &amp; more
#first
<!-- == hidden == -->
<pre>
* no item
  kept
</pre>
<syntaxhighlight lang="x">
== no ==
</syntaxhighlight>
{| class="wikitable"
! a !! b
|-
| * c || d
|}
; term : definition
[[Category:X]]
"""


def test_wiki():
    assert M.page_format(WIKI) == "wiki"
    assert M.elements(WIKI) == [
        ("formula", "a \\le b"),
        ("heading", "The big page"),
        ("list_item", "one shown"),
        ("list_item", "nested & more"),
        ("list_item", "first"),
        ("code", "* no item\n  kept"),
        ("code", "== no =="),
    ]


TEX = r"""\documentclass{article}
\title{No heading}
\begin{document}
\maketitle
\section*{The \emph{big} \href{http://a/b}{page}}\label{s:a}
% \section{hidden}
Costs \$5 or \$6, here $a < b$ and \(c\).~\cite{x} % $no$
\begin{itemize}
  \item one \& {\it two}
\item a\_b
  \begin{enumerate}
    \item nested
  \end{enumerate}
\end{itemize}
\begin{verbatim}
\item no % kept
  x
\end{verbatim}
\begin{lstlisting}[language=C]
int a;
\end{lstlisting}
\begin{equation}
  x^2
\end{equation}
\[ y \]
\begin{description}
\item[t] d
\end{description}
\end{document}
\section{after}
"""


def test_latex():
    assert M.page_format(TEX) == "latex"
    assert M.elements(TEX) == [
        ("heading", "The big page"),
        ("formula", "a < b"),
        ("formula", "c"),
        ("list_item", "one & two"),
        ("list_item", "a_b"),
        ("list_item", "nested"),
        ("code", "\\item no % kept\n  x"),
        ("code", "int a;"),
        ("formula", "x^2"),
        ("formula", "y"),
    ]


@pytest.mark.parametrize("page", [None, "", "  \n", "Just a text.\nWith lines.", "Tags: #a #b", "<"])
def test_no_elements(page):
    assert M.elements(page) == []


def test_element_operator(spark):
    df = spark.createDataFrame([(1, MD, "x"), (2, None, "x"), (3, " ", "x"), (4, "<h1>a</h1><p>b</p>" + "<p>w</p>" * 20_000, "x")], "page_id long, page string, kind string")
    got = rows(M.page_elements(df.unionAll(df)).drop("main"))
    assert [g[1] for g in got if g[0] == 1] == list(range(1, 14)) and (4, 1, "heading", "a") in got and {g[0] for g in got} == {1, 4}
    assert M.page_elements(df.limit(0)).count() == 0
    texts = {r["page_id"]: (r["format"], r["text"]) for r in M.clean_texts(df).collect()}
    assert texts[2] == (None, None) and texts[3] == ("text", "") and texts[1][0] == "markdown"


def test_tag_paths_choose_the_body():
    page = "<body><div><ul><li><a href='/a'>Home</a></li><li><a href='/b'>Help</a></li></ul></div><main><h1>Head of it</h1>" + "".join(f"<p>This is sentence {i}, and it goes on, as prose does; it ends here.</p>" for i in range(6)) + "</main><div>x</div></body>"
    text = M.main_text(page)
    assert text.count("sentence") == 6 and "Home" not in text


PAGE = """<!DOCTYPE html>
<head><title>The bridge was closed - Site</title></head>
<body>
<div class="notice">We use cookies to make this site work. By staying here you agree to that.</div>
<nav>
<li><a href="/home">Home</a></li>
<li><a href="/about">About us</a></li>
</nav>
<div class="zz1">
<h1>The bridge was closed</h1>
<div>By the Site desk | 3 min read</div>
<p>The bridge was closed in spring. Nobody knew why, and nobody asked. It was opened later.</p>
<div>Advertisement</div>
<pre>x = 1

y = 2</pre>
<ul>
<li>four old stones</li>
</ul>
<!-- no line -->
<p>It stands there still, as it did. People walk over it every day.</p>
</div>
<div class="zz2">
<h3>Related</h3>
<p>The tower fell down. <a href="/t">…</a></p>
<p>The market was moved to the harbour. It is open again.</p>
</div>
<footer>
<p>© 2020 Site</p>
<p>All rights reserved.</p>
</footer>
</body></html>"""


def test_main_body():
    lines = PAGE.split("\n")
    own = {k for k, x in enumerate(lines, 1) if x.startswith(("<h1>", "<p>The ", "<pre>", "y = 2", "<li>four", "<p>It stands"))}
    repeated = as_in_a_collection(PAGE, own)
    got = [lines[k - 1] for k in B.body_lines(PAGE, None, repeated)]
    assert got == [x for x in lines if x.startswith(("<h1>", "<p>The bridge", "<pre>", "y = 2", "<li>four", "<p>It stands"))]
    assert B.body_lines(PAGE.replace("\n", "\r\n"), None, repeated) == B.body_lines(PAGE, None, repeated)


TEXT = """Skip to content
Home | Help | About us
We use cookies to make this site work. By staying here you agree to that.

Most read
The tower fell
A market by the river

The bridge was closed
Updated: 3 hours ago · 3 comments
The bridge was closed in spring. Nobody knew why, and nobody asked.
Sign up for our weekly letter and never miss a story.
How it was opened
It stands there still, as it did. People walk over it every day.

Like | Share | Save
Related
The old mill was sold.
© 2020 Site
All rights reserved."""


def test_main_body_of_text():
    url = "http://a.example/en/the-bridge-was-closed-1a"
    repeated = as_in_a_collection(TEXT, {6, 7, 9, 11, 13, 14, 18}, url)
    assert B.body_lines(TEXT, url, repeated) == [9, 11, 13, 14]


def test_cut_is_least():
    rnd = random.Random(3)
    for _ in range(150):
        n = rnd.randint(1, 7)
        cost = [rnd.choice([-3, -1.5, -1, 0, 0.5, 1, 2]) for _ in range(n)]
        edges = [{} for _ in range(n)]
        for a, b in itertools.combinations(range(n), 2):
            if rnd.random() < 0.5:
                edges[a][b] = edges[b][a] = rnd.choice([0.25, 0.5, 1, 2])

        def total(labels):
            own = sum(max(0, -c) if x else max(0, c) for c, x in zip(cost, labels, strict=True))
            return own + sum(w for a in range(n) for b, w in edges[a].items() if a < b and labels[a] != labels[b])

        got = B.min_cut(cost, edges)
        assert total(got) == pytest.approx(min(total(x) for x in itertools.product([False, True], repeat=n)))


def test_body_operator(spark):
    df = spark.createDataFrame([(1, PAGE, None, 0), (2, None, "u", 0), (3, "\n", "u", 0), (4, "word " * 100_000, "u", 0)], "page_id long, page string, url string, line_no int")
    got = rows(B.main_bodies(df))
    assert {g[0] for g in got} <= {1, 4} and [g[1] for g in got if g[0] == 1] == B.body_lines(PAGE)
    assert rows(B.main_bodies(df, most_sent=0)) == got
    assert B.main_bodies(df.limit(0)).count() == 0


PROSE = "The bridge was closed in spring, and nobody knew why. We walked to the harbour, where a market is held on most days. It was not open, but the keeper said that it would be. Between the mill and the river there is a path that few people know."
KEYS = "cheap boots, best boots, buy boots online, boots sale, top boots, boots discount, new boots, boots cheap, original boots, boots best, wholesale boots"


@pytest.mark.parametrize(
    "page,stuffed",
    [
        (PROSE, False),
        (PROSE + "\n" + PROSE.replace("bridge", "tower"), False),
        ((KEYS + " ") * 4, True),
        (f"<p>{PROSE}</p><div style='display:none'>{(KEYS + ' ') * 6}</div>", True),
        ("\n".join(f"boots shop in {t}, boots shop {t}." for t in "Aville Bville Cville Dville Eville Fville Gville Hville Iville Jville".split() * 3), True),
        ("<ul>" + "".join(f"<li><a href='https://h{i}.example/p{i}'>Name{i} thing</a></li>\n" for i in range(40)) + "</ul>", True),
        ("".join(f"#tag{i}; #word{i * 7}; #size-{i}; " for i in range(60)), True),
        ("Our boots are best boots, boots and boots! Why boots? Because boots means new boots. Boots is the fast boots for boots. " * 3, True),
        ("<h1>Not found</h1><p>This page does not exist any more.</p>", False),
        ("<dl>" + "".join(f"<dt>word{i}</dt><dd>{s}.</dd>\n" for i, s in enumerate(PROSE.split(". ") * 2)) + "</dl>", False),
    ],
)
def test_stuffed(page, stuffed):
    share = S.stuffed_share(page)
    assert ((share or 0) > S.MOST) is stuffed


def test_stuffed_operator(spark):
    df = spark.createDataFrame([(1, PROSE, "u", 0.0), (2, None, None, 0.0), (3, "", None, 0.0), (4, (KEYS + " ") * 2000, None, 0.0)], "page_id long, page string, url string, share double")
    got = {r["page_id"]: r["share"] for r in S.stuffed_shares(df.unionAll(df)).collect()}
    assert got[2] is None and got[3] is None and got[4] == 1.0 and got[1] < 0.2
    assert S.stuffed_shares(df.limit(0)).count() == 0


URLS = [f"https://h{i}.example/p{i * 7}/index" for i in range(40)]


@pytest.mark.parametrize(
    "page,stuffed",
    [
        ("\n".join(URLS), True),
        ("\n".join(f"{i}. {u}" for i, u in enumerate(URLS, 1)), True),
        ("\n".join(f"* <{u}>" for u in URLS), True),
        ("".join(f"<li>{u}</li>\n" for u in URLS), True),
        ("\n".join(f"<{u.upper()}>" for u in URLS), True),
        (PROSE + "\n" + PROSE.replace("bridge", "tower") + "\n" + "\n".join(f"<{u}>" for u in URLS[:4]), False),
        ("\n".join(f"{i} {i * 37 % 101} {i * 11 % 89}" for i in range(200)), False),
        ("\n".join(["* * *", "-----"] * 40), False),
    ],
)
def test_bare_addresses(page, stuffed):
    share = S.stuffed_share(page)
    assert ((share or 0) > S.MOST) is stuffed


@pytest.mark.parametrize("run", [499, 500, 501, 1200, 5000])
def test_long_runs_after_a_space_are_cut(run):
    line = "data: " + "x" * run + " " + "y" * run + " end" * 300
    blocks = S.own_blocks(line)
    assert "".join(blocks) == line and max(map(len, blocks)) <= 2 * S.BLOCK_CHARS


def test_headline_before_a_byline():
    page = "Home | Help | About us | Shop\nWe use cookies to make this site work. By staying here you agree to that.\n\nAnother headline here\nPosted 3 days ago in News\nThe first sentence stands here. The second does too, as it should.\n\nLike | Share | Save\n© 2020 Site"
    assert B.body_lines(page, None, as_in_a_collection(page, {4, 6})) == [4, 6]


def test_inner_tables_stay_in_their_cell():
    page = """<BODY><TABLE><TR><TD>
<a href="#c">Toggle menu</a>
<h1>Headline of it</h1>
<P>The first sentence stands here. The second does too, as it should.
<table>
<tr><td>stone</td><td>2</td></tr>
</table>
<P>The third sentence stands here. The fourth does too, as it should.
</TD><TD>
<h3>Related</h3>
<p>The tower fell down. It was old, and nobody was hurt.</p>
</TD></TR></TABLE></BODY>"""
    assert B.body_lines(page, None, as_in_a_collection(page, {3, 4, 6, 8, 11})) == [3, 4, 6, 8]


ARTICLE = """<html><body><div class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">Help</a></li><li><a href="/c">About</a></li></ul></div>
<div class="article"><h1>How the bridge was built</h1>
<p>The bridge was built in spring, by many hands; it has four arches, as the old one had.</p>
<h2>The program</h2>
<p>It was planned with a program, which is short, and which anyone can read: \\(a &lt; b\\) holds in it, and $$c = d$$ too.</p>
<pre><code>def f():
    return 1

x = 2
</code></pre>
<ul><li>The first stone was laid in April, and the last in May, when it had stopped raining.</li></ul>
<p>It stands there still, as it did then, and people walk over it every day, in all weather.</p></div>
<div class="foot"><p><a href="/x">Imprint</a></p></div></body></html>"""


def test_clean_text_of_html_keeps_structure():
    assert M.main_text(ARTICLE).split("\n") == [
        "# How the bridge was built",
        "The bridge was built in spring, by many hands; it has four arches, as the old one had.",
        "## The program",
        "It was planned with a program, which is short, and which anyone can read: $a < b$ holds in it, and $$c = d$$ too.",
        "```",
        "def f():",
        "    return 1",
        "",
        "x = 2",
        "```",
        "- The first stone was laid in April, and the last in May, when it had stopped raining.",
        "It stands there still, as it did then, and people walk over it every day, in all weather.",
    ]


def test_elements_are_marked_by_their_node():
    got = M.marked_elements(ARTICLE)
    assert [(k, m) for k, _, m in got] == [("list_item", False)] * 3 + [("heading", True), ("heading", True), ("formula", True), ("formula", True), ("code", True), ("list_item", True)]
    assert [(k, c) for k, c, _ in got] == M.elements(ARTICLE)


@pytest.mark.parametrize("depth", [1, 40, 41, 400])
def test_nested_quotes_and_emphasis(depth):
    assert M.elements("Text with **bold**.\n\n" + "> " * depth + "# Deep down\n" + "> " * depth + "\n" + "> " * depth + "* item") == [("heading", "Deep down"), ("list_item", "item")]
    text, words = "deep", "deep"
    for k in range(depth):
        sign = ("*", "**")[k % 2]
        text, words = f"{sign}a {text} b{sign}", f"a {words} b"
    assert M.md_inline(text) == words and M.md_inline("*" * depth + "deep" + "*" * depth) == "deep"
    assert M.tex_inline("\\emph{" * depth + "deep" + "}" * depth) == "deep"


def test_one_long_line_of_quotes():
    assert M.elements("**a**\n\n" + ">" * 50_000 + " # deep") == [("heading", "deep")]
