"""Main body of pages: lines labelled content or boilerplate by a minimum cut.

Every line with visible text is a node; so is every DOM container (of a page without markup, every section that a
section heading opens).  A linear classifier over the line's own features gives its terminal capacities: the cost of
calling it boilerplate on one side, of calling it content on the other.  Smoothness edges join lines that follow each
other and lines with their container; containers are joined to the one around them.  The labelling of least cost is the
minimum cut.  Nodes whose own cost outweighs all their edges are decided first (they are so in some minimum cut), and
what they decide is passed on; the few that are left go through a maximum flow.

Lines are those of ``page`` split at line feeds, counted from 1.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm.frames import MOST_SENT, SentCounts, counted, distinct_bodies

# ---------------------------------------------------------------- fixed values: names of containers, as markup has them
_FRAME_NAME = re.compile(
    r"(?<![a-z])(?:nav|menu|side|rail|aside|related|recommend|promo|foot|bottom|colophon|cookie|consent|notice|banner|links?\b|share|social|comment|teaser|advert|ads?\b|by(?:line)?\b|meta|breadcrumb|masthead|topbar|toolbar|widget|extra|legal|subscribe|newsletter|popup|modal)|(?:nav|menu|footer|sidebar)\b",
    re.I,
)
_BODY_NAME = re.compile(r"\b(?:main|article|content|entry|post|story|text)\b|post-body|entry-content|article-body|main-content", re.I)

#: What the classifier reads of a line, in this order; the same of the lines before and after it, or on average of the
#: others of its container, where the name says so.
FEATURES = """
one sentence more_sentences length code block cell linked teaser title many_pieces handle
repeated first_repeated last_repeated
before_repeated after_repeated around_frame
""".split()
#: Weights of the features in pages with block markup and in those without, fitted by ``fit`` (see the README for the rows
#: and the figures); above 0: content.
WEIGHTS = {
    True: [
        18.93, 3.5, 3.25, -2.86, 14.39, 5.33, 15.91, -3.68, -15.06, 12.04, 1.81, -1.01,
        -19.43, -12.57, 0.22, -3.38, -2.83, -14.22,
    ],
    False: [
        1.38, 0.43, 1.1, -0.03, 13.62, 0.0, 0.0, 0.0, 0.0, 12.84, -0.84, -8.61,
        -8.63, -6.0, -1.43, 0.0, 0.0, 0.0,
    ],
}
#: Costs of containers by their name, and of sections that a repeated line opens.
W_FRAME, W_BODY, W_SECTION = -6.0, 3.0, -7.0
# capacities of smoothness edges
E_NEXT, E_FAR, E_BLANK, E_INSIDE, E_AROUND, E_SECTION = 0.6, 0.1, 0.3, 3.5, 0.3, 3.0
#: Repetition from which a short line without a sentence opens a section, or ends one.
OPENS = 0.6

_INVISIBLE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>|<[!?][^<>]*>")
_BLOCKS = frozenset("h1 h2 li tr td blockquote dt dd p".split())
_CONTAINERS = frozenset("div nav aside main article section header footer td form".split())
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?=\s|$)")
_STOPS = frozenset(".!?…。！？")
_SEPARATORS = re.compile(r"[:|·›»>•]|\s{2,}")
_HANDLE = re.compile(r"^(?=\w*[^\W\d])(?=\w*\d)\w+: ")
_TITLE = re.compile(r"<title[^<>]*>(.*?)(?:</title|$)", re.I)
_PLAIN = re.compile(r"[^\W_]+")
_OWN, _LINKED = FEATURES.index("repeated"), FEATURES.index("linked")


def _norm(s: str) -> str:
    return " ".join(_PLAIN.findall(s.lower()))


def _slug(url: str | None) -> str:
    """Letters and digits of the last part of a URL's path that has words."""
    if not url:
        return ""
    path = re.sub(r"^[a-z]+://[^/]*", "", url.split("#")[0].split("?")[0])
    parts = [p for p in path.split("/") if p]
    return "-".join(re.findall("[a-z0-9]+", parts[-1].lower())) if parts else ""


@lru_cache(maxsize=1 << 12)
def _named(attributes: str) -> float:
    if _FRAME_NAME.search(attributes):
        return W_FRAME
    return W_BODY if _BODY_NAME.search(attributes) else 0.0


class Lines:
    """Nodes of one page: visible lines, and their containers."""

    def __init__(self, page: str, url: str | None = None, bare: bool = False):
        self.bare = bare  # no features
        self.number: list[int] = []
        self.text: list[str] = []
        self.features: list[list[float]] = []
        self.hint: list[float] = []
        self.linked: list[int] = []
        self.unary: list[float] = []
        self.inside: list[int] = []
        self.blank_before: list[bool] = []
        self.parents = [-1]
        self.hints = [0.0]
        title = _TITLE.search(page)
        self.titles = {_norm(unescape(title.group(1)))} if title else set()
        self.slug = _slug(url)
        self.markup = bool(re.search(r"</?(?:div|p|td|li|body|h[1-6]|br)\b", page, re.I))
        self._scan(page)

    def _scan(self, page: str) -> None:
        if "<" in page:
            page = _INVISIBLE.sub(lambda m: "\n" * m.group().count("\n"), page)
        stack: list[tuple[str, int]] = []
        in_link = pre = False
        blank = True
        for number, line in enumerate(page.split("\n"), 1):
            if "<" not in line:
                text = line.strip()
                if not text:
                    blank = True
                    continue
                if "&" in text:
                    text = " ".join(unescape(text).split())
                if text:
                    self._add(number, text, len(text) if in_link else 0, stack[-1][1] if stack else 0, 0.0, (), pre, blank)
                    blank = False
                continue
            parts: list[str] = []
            linked, at = 0, 0
            base: int | None = None  # depth of the stack from the first text on
            hint = 0.0
            tags: list[str] = []
            was_pre = pre
            for m in _TAG.finditer(line):
                start = m.start()
                if start > at:
                    chunk = line[at:start]
                    if parts or not chunk.isspace():
                        parts.append(chunk)
                        if in_link:
                            linked += len(chunk)
                        base = len(stack) if base is None else min(base, len(stack))
                at = m.end()
                shut, tag, attributes = m.groups()
                if not tag:
                    continue
                tag = tag.lower()
                if tag == "a":
                    in_link = not shut
                elif tag in _CONTAINERS:
                    in_link = False
                    if shut:
                        if any(t == tag for t, _ in stack):
                            while stack.pop()[0] != tag:
                                pass
                        if base is not None:
                            base = min(base, len(stack))
                        if parts and tag == "td":
                            parts.append(" ")
                    else:
                        if tag == "td":
                            if stack and stack[-1][0] == "td":
                                stack.pop()
                            tags.append(tag)
                        name = 0.0
                        if tag in ("nav", "aside", "footer", "header"):
                            name = W_FRAME
                        elif tag in ("main", "article"):
                            name = W_BODY
                        elif attributes:
                            name = _named(attributes)
                        self.parents.append(stack[-1][1] if stack else 0)
                        self.hints.append(name)
                        stack.append((tag, len(self.parents) - 1))
                        if base is None:
                            hint = min(hint, name)
                elif tag == "table":
                    # a mark only, so that its cells don't end the cell that it stands in
                    if not shut:
                        stack.append((tag, stack[-1][1] if stack else 0))
                    elif any(t == tag for t, _ in stack):
                        while stack.pop()[0] != tag:
                            pass
                        if base is not None:
                            base = min(base, len(stack))
                elif tag == "hr":
                    # a thematic break: what follows is another part of the container
                    if stack:
                        self.parents.append(stack[-2][1] if len(stack) > 1 else 0)
                        self.hints.append(self.hints[stack[-1][1]])
                        stack[-1] = (stack[-1][0], len(self.parents) - 1)
                elif tag == "pre":
                    pre = not shut
                    was_pre = True
                else:
                    tags.append(tag)
                    if parts and tag in ("br", "p", "li", "dd", "dt"):
                        parts.append(" ")
            if at < len(line):
                chunk = line[at:]
                if parts or not chunk.isspace():
                    parts.append(chunk)
                    if in_link:
                        linked += len(chunk)
                    base = len(stack) if base is None else min(base, len(stack))
            text = " ".join(unescape("".join(parts)).split()) if parts else ""
            if not text:
                continue
            depth = min(base if base is not None else len(stack), len(stack))
            self._add(number, text, linked, stack[depth - 1][1] if depth else 0, hint, tags, was_pre or pre, blank)
            blank = False

    def _add(self, number: int, text: str, linked: int, container: int, hint: float, tags: list[str] | tuple[str, ...], pre: bool, blank: bool) -> None:
        self.number.append(number)
        self.text.append(text)
        self.inside.append(container)
        self.blank_before.append(blank)
        self.hint.append(min(hint, 0.0))
        self.linked.append(linked)
        if self.bare:
            return
        words = text.count(" ") + 1  # white space is squeezed, but in bare lines; near enough
        ends = len(_SENTENCE.findall(text)) if not pre and not _STOPS.isdisjoint(text) else 0
        # writing without spaces has few words, but as many bytes
        sentence = ends > 0 and (words >= 4 or len(text.encode()) >= 24)
        share = linked / len(text) if linked else 0.0
        self.features.append([
            1.0,
            float(sentence),
            min(3.0, ends - 1.0) if sentence else 0.0,
            min(5.0, log2(1 + words)),
            float(pre),
            float(share <= 0.6 and not _BLOCKS.isdisjoint(tags)),
            float("td" in tags),
            share,
            float(linked > 0 and text.endswith("…")),
            float(1 < words < 30 and self._is_title(text)),
            float(not sentence and not pre and len(_SEPARATORS.findall(text)) > 1),
            float(_HANDLE.match(text) is not None),
        ])

    def weigh(self, repeated: np.ndarray | None, weights: dict[bool, list[float]] = WEIGHTS) -> None:
        """Own costs of the lines, and of a page without markup its sections.  ``repeated`` has the repetition of each line
        of the page (see ``frames.repetition``)."""
        x = self.matrix(repeated)
        if len(x):
            self.unary = (x @ np.array(weights[self.markup]) + np.array(self.hint)).tolist()
        if not self.markup:
            self._sections(x)

    def matrix(self, repeated: np.ndarray | None) -> np.ndarray:
        """A row of FEATURES for each line."""
        n = len(self.text)
        out = np.zeros((n, len(FEATURES)))
        if n == 0:
            return out
        out[:, :_OWN] = self.features
        if repeated is not None:
            out[:, _OWN : _OWN + 3] = repeated[np.array(self.number) - 1]
        own = out[:, _OWN]
        rest = out[:, _OWN + 3 :]
        rest[1:, 0], rest[:-1, 1] = own[:-1], own[1:]
        if self.markup:
            inside = np.array(self.inside)
            frame = np.maximum(own, out[:, _LINKED : _LINKED + 2].max(axis=1))  # repeated, linked or a teaser
            rest[:, 2] = (np.bincount(inside, frame)[inside] - frame) / np.maximum(np.bincount(inside)[inside] - 1, 1)
        return out

    def _is_title(self, text: str) -> bool:
        n = _norm(text)
        if len(n) < 8:
            return False
        if any(t.startswith(n) for t in self.titles):
            return True
        slug = "-".join(re.findall("[a-z0-9]+", text.lower()))
        return len(slug) >= 12 and self.slug.startswith(slug)

    def _sections(self, x: np.ndarray) -> None:
        """Sections of a page without markup: a short repeated line opens one; it ends before a blank line, another
        repeated line, or a paragraph of several sentences."""
        current = 0
        for i, row in enumerate(x.tolist()):
            repeated, sentence, more = row[_OWN], row[1], row[2]
            if repeated >= OPENS and not sentence and row[_OWN + 1] == 0 and self.text[i].count(" ") < 5:
                self.parents.append(0)
                self.hints.append(W_SECTION)
                current = len(self.parents) - 1
                self.inside[i] = current
                continue
            if self.blank_before[i] or repeated >= OPENS or sentence and more > 0:
                current = 0
            if current:
                self.inside[i] = current


def label(page: Lines) -> list[bool]:
    """Which lines are content: the minimum cut."""
    n = len(page.unary)
    if n == 0:
        return []
    used = sorted({c for i in page.inside for c in _chain(page.parents, i)})
    hub = {c: n + k for k, c in enumerate(used)}
    cost = page.unary + [page.hints[c] for c in used]
    edges: list[dict[int, float]] = [{} for _ in cost]

    def join(a: int, b: int, w: float) -> None:
        edges[a][b] = edges[a].get(b, 0.0) + w
        edges[b][a] = edges[b].get(a, 0.0) + w

    for i in range(n):
        if i + 1 < n:
            same = page.inside[i] == page.inside[i + 1]
            join(i, i + 1, (E_BLANK if page.blank_before[i + 1] and not page.markup else E_NEXT) if same else E_FAR)
        c = page.inside[i]
        if c:
            join(i, hub[c], E_INSIDE if page.markup else E_SECTION)
    for c in used:
        if page.parents[c] > 0:
            join(hub[c], hub[page.parents[c]], E_AROUND)
    return min_cut(cost, edges)[:n]


def _chain(parents: list[int], c: int) -> Iterator[int]:
    while c > 0:
        yield c
        c = parents[c]


def min_cut(cost: list[float], edges: list[dict[int, float]]) -> list[bool]:
    """Labels of least total cost: a node labelled True pays max(0, -cost), False pays max(0, cost), and each edge its
    capacity where its ends differ.  Of equal cuts, the one with the fewest True."""
    n = len(cost)
    cost = list(cost)
    edges = [dict(e) for e in edges]
    result: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # decided by their own cost
        v = queue.popleft()
        if result[v] is not None:
            continue
        around = sum(edges[v].values())
        if cost[v] > around or -cost[v] >= around:
            result[v] = cost[v] > around
            for u, w in edges[v].items():
                cost[u] += w if result[v] else -w
                edges[u].pop(v, None)
                queue.append(u)
            edges[v] = {}
    rest = [v for v in range(n) if result[v] is None]
    if rest:
        _max_flow(cost, edges, rest, result)
    return [bool(r) for r in result]


def _max_flow(cost: list[float], edges: list[dict[int, float]], rest: list[int], result: list[bool | None]) -> None:
    """Shortest augmenting paths; sources have a positive cost, sinks a negative one."""
    supply = {v: cost[v] for v in rest if cost[v] > 0}
    demand = {v: -cost[v] for v in rest if cost[v] < 0}
    flow = {v: dict(edges[v]) for v in rest}  # residual capacities
    tiny = 1e-9
    while True:
        before: dict[int, int] = {v: -1 for v, s in supply.items() if s > tiny}
        queue = deque(before)
        end = -1
        while queue:
            v = queue.popleft()
            if demand.get(v, 0.0) > tiny:
                end = v
                break
            for u, w in flow[v].items():
                if w > tiny and u not in before:
                    before[u] = v
                    queue.append(u)
        if end < 0:
            for v in rest:  # reachable from the source side: content
                result[v] = v in before
            return
        path = [end]
        while before[path[-1]] >= 0:
            path.append(before[path[-1]])
        path.reverse()
        push = min(supply[path[0]], demand[end], *(flow[a][b] for a, b in zip(path, path[1:]))) if len(path) > 1 else min(supply[path[0]], demand[end])
        supply[path[0]] -= push
        demand[end] -= push
        for a, b in zip(path, path[1:]):
            flow[a][b] -= push
            flow[b][a] = flow[b].get(a, 0.0) + push


def body_lines(page: str | None, url: str | None = None, repeated: np.ndarray | None = None) -> list[int]:
    """Numbers of the lines of a page's main body; none of a null or blank page.  ``repeated`` has the repetition of each of
    its lines; without it nothing is known to repeat."""
    if not page or page.isspace():
        return []
    lines = Lines(page, url)
    lines.weigh(repeated)
    return [k for k, keep in zip(lines.number, label(lines), strict=True) if keep]


def main_bodies(wanted: DataFrame, pages: DataFrame | None = None, key: str = "page_id", text: str = "page", url: str = "url", most_sent: int = MOST_SENT) -> DataFrame:
    """(key, line_no int) of the lines of the main body of each wanted page.

    Each row of ``wanted`` is one page.  What repeats is counted over ``pages`` (the wanted ones where none are given), in
    distinct bodies; that job runs when this is called.  Other columns, whatever their names, are not read.  Null and blank
    pages give no row; a null url is no hint, and its pages are one host.
    """
    src = wanted.select(F.col(key).alias("k"), F.col(text).cast("string").alias("page"), F.col(url).cast("string").alias("url"))
    counts = SentCounts(src.sparkSession, counted(distinct_bodies(wanted if pages is None else pages, text, url)), most_sent)
    table = counts.table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = SentCounts.reader(table)
        for batch in batches:
            at, number = [], []
            columns = (batch.column(1).to_pylist(), batch.column(2).to_pylist(), read(batch))
            for i, (page, address, repeated) in enumerate(zip(*columns, strict=True)):
                found = body_lines(page, address, repeated)
                at += [i] * len(found)
                number += found
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(number, pa.int32())], names=["k", "line_no"])

    fields = [src.schema["k"], T.StructField("line_no", T.IntegerType())]
    return counts.beside(src).mapInArrow(run, T.StructType(fields)).withColumnRenamed("k", key)
