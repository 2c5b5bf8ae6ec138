"""Terms of pages: their frequency over the collection, and how distinctive they are for a page.

A page's terms: each tag (``<`` to the next ``>`` or the end of the page, no other ``<`` between) is a space; the rest is
lower-cased; each longest run of a-z and 0-9 is a term.  Whole texts are read and all pages count.

*Frequency.*  The pages of a block (some MB of text) are one sequence of term codes.  Its suffix array, sorted as deep
as the longest n-gram asked for, has the occurrences of an n-gram as one interval of common prefix: its length is the
number of occurrences, and less those entries whose predecessor of the same page lies in the interval too it is the
number of pages.  The root interval, of the empty n-gram, has the number of all pages.  Blocks give (n-gram,
occurrences, pages), which Spark adds up; what is shuffled is vocabulary, not text.

*Distinctiveness.*  In the graph of words of a page an edge links terms that stand within a window; a term's weight is
its number of distinct neighbours (itself among them, where it repeats within the window), not its frequency, times
``ln(1 + pages / pages with the term)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text whose codes are sorted at once.
BLOCK_BYTES = 6_000_000
#: Terms of a window of the graph of words: a term is linked with the next WINDOW - 1.
WINDOW = 4
#: Most terms that are broadcast as frequent ones: each has at least this share of all (page, term) pairs.
HOT_TERMS = 50_000

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The letters beyond ASCII whose lower case has an ASCII letter: U+0130 and U+212A, in UTF-8.
_ODD_CASE = (b"\xc4\xb0", b"\xe2\x84\xaa")


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def code_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number of each term, its code, the term of each code), in reading order.  Null texts have no terms."""
    if texts.null_count:
        texts = texts.fill_null("")
    raw, off = _buffers(texts)
    if len(raw) and any(x in raw.tobytes() for x in _ODD_CASE):
        raw, off = _buffers(pa.array([t.lower() for t in texts.to_pylist()], pa.large_string()))
    size = len(raw)
    if size == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), pa.array([], pa.string())
    good = _TERM[raw]
    angles = np.flatnonzero((raw == 60) | (raw == 62))
    if len(angles):
        ends = off[np.searchsorted(off, angles, "right")]
        nxt = np.append(angles[1:], size)
        opening = raw[angles] == 60
        last = nxt >= ends
        closed = opening & ~last & (raw[np.minimum(nxt, size - 1)] == 62)
        upto = np.where(last, ends, nxt + 1)
        tag = opening & (last | closed)
        delta = np.zeros(size + 1, np.int8)
        delta[angles[tag]] += 1
        delta[upto[tag]] -= 1
        good &= np.cumsum(delta[:-1], dtype=np.int8) == 0
    begin = good.copy()
    begin[1:] &= ~good[:-1]
    edges = off[1:-1]
    edges = edges[edges < size]
    begin[edges] = good[edges]
    start = np.flatnonzero(begin)
    if len(start) == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), pa.array([], pa.string())
    before = np.concatenate([[0], np.cumsum(good, dtype=np.int64)])
    body = _LOWER[raw[good]]
    offsets = np.append(before[start], len(body))
    terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body))
    coded = terms.dictionary_encode()
    text = np.searchsorted(off[1:], start, "right").astype(np.int32)
    return text, np.asarray(coded.indices).astype(np.int32), coded.dictionary.cast(pa.string())


def suffix_intervals(text: np.ndarray, code: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, first occurrence, occurrences, texts) of the intervals of n-grams of each length n from 1 to max_n.

    ``text`` ascends.  N-grams don't reach over the end of a text.
    """
    size = len(code)
    if size == 0:
        return
    place = np.arange(size, dtype=np.int64)
    left = np.searchsorted(text, text, "right") - place if max_n > 1 else None  # terms from here to the text's end
    rank, depth = code.astype(np.int64), 1
    while depth < max_n:  # prefix doubling
        ahead = np.zeros(size, np.int64)
        inside = np.flatnonzero(left > depth)
        ahead[inside] = rank[inside + depth] + 1
        _, rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)
        rank, depth = rank.astype(np.int64), depth * 2
    # ties stay in reading order, so by text
    order = np.sort((rank << 32) | place) & 0xFFFFFFFF
    t = text[order]
    common = np.zeros(size, np.int32)  # with the predecessor, up to max_n
    alive = np.ones(size - 1, bool)
    for k in range(max_n):
        a, b = order[1:] + k, order[:-1] + k
        if k:
            alive &= (left[order[1:]] > k) & (left[order[:-1]] > k)
        alive &= code[np.minimum(a, size - 1)] == code[np.minimum(b, size - 1)]
        common[1:] += alive
    if max_n == 1:
        previous = np.arange(-1, size - 1)
        same = np.zeros(size, bool)
        same[1:] = t[1:] == t[:-1]
    else:  # the predecessor of the same text in the order of suffixes
        by_text = np.sort((t.astype(np.int64) << 32) | place) & 0xFFFFFFFF
        previous = np.full(size, -1, np.int64)
        twin = t[by_text[1:]] == t[by_text[:-1]]
        previous[by_text[1:][twin]] = by_text[:-1][twin]
        same = previous >= 0
    for n in range(1, max_n + 1):
        group = np.cumsum(common < n) - 1
        whole = np.ones(size, bool) if n == 1 else left[order] >= n
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        repeat = same & (group[np.maximum(previous, 0)] == group)
        count = np.bincount(group[whole], minlength=len(first))
        doubles = np.bincount(group[whole & repeat], minlength=len(first))
        real = whole[first]
        yield n, order[first[real]], count[real], (count - doubles)[real]


def blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most BLOCK_BYTES of text, or one row."""
    for batch in batches:
        _, off = _buffers(batch.column(column).fill_null("")) if batch.num_rows else (None, np.zeros(1, np.int64))
        i, n = 0, batch.num_rows
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + BLOCK_BYTES, "right")) - 1))
            yield batch.slice(i, j - i)
            i = j


def _count_blocks(max_n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n", "term", "occurrences", "pages"]
        for block in blocks(batches, 0):
            text, code, terms = code_terms(block.column(0))
            rows = pa.array([0], pa.int32()), pa.array([""]), pa.array([len(code)], pa.int64()), pa.array([block.num_rows], pa.int64())
            yield pa.RecordBatch.from_arrays(list(rows), names=names)
            for n, first, count, records in suffix_intervals(text, code, max_n):
                if n == 1:
                    grams = terms.take(pa.array(code[first]))
                else:
                    words = [terms.take(pa.array(code[first + k])) for k in range(n)]
                    grams = pc.binary_join_element_wise(*words, " ")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), n, np.int32)), grams, pa.array(count.astype(np.int64)), pa.array(records.astype(np.int64))], names=names)

    return run


def gram_counts(bodies: DataFrame, text: str = "page", max_n: int = 1, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """(term, n, occurrences, pages) of every n-gram of up to ``max_n`` terms; n = 0, term '' has all terms and pages.

    The suffix arrays are sorted to depth ``max_n``; of their intervals those of ``lengths`` come out, all where none are
    given.  Each row of ``bodies`` is one page; null and empty texts have no terms but count as pages.  An empty table gives
    no rows.  Only ``text`` is read.
    """
    partial = bodies.select(F.col(text).cast("string")).mapInArrow(_count_blocks(max_n), "n int, term string, occurrences long, pages long")
    partial = partial.where("term is not null")  # none is; joins by term would put this condition into their own plan only
    if lengths is not None:
        partial = partial.where(F.col("n").isin(0, *lengths))
    # an n-gram has one length; as an aggregate it keeps conditions on it behind the shuffle, which all readers share
    return partial.groupBy("term").agg(F.max("n").alias("n"), F.sum("occurrences").alias("occurrences"), F.sum("pages").alias("pages"))


def _totals(counts: DataFrame) -> Column:
    """struct(all pages, pairs of term and page), from the same shuffled counts as their other readers: it asks for the same
    columns."""
    n, pages = F.col("n"), F.col("pages")
    each = counts.where("occurrences >= 0")
    return each.agg(F.struct(F.max(F.when(n == 0, pages)).alias("pages"), F.sum(F.when(n == 1, pages)).alias("pairs")).alias("t")).scalar()


def marked(counts: DataFrame, common_percent: int = 40) -> DataFrame:
    """Adds mark: rare (one page), common (more than common_percent % of the pages), else null.

    Where one page is more than that share, the mark is rare.
    """
    mark = F.when(F.col("pages") == 1, "rare").when(F.col("pages") * 100 > _totals(counts)["pages"] * common_percent, "common")
    return counts.where("n > 0 and occurrences >= 0").withColumn("mark", mark)


def _graph_blocks(window: int, min_tf: int, max_pages: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            text, code, terms = code_terms(block.column(1))
            if len(code) == 0:
                continue
            pair, which, tf = np.unique((text.astype(np.int64) << 32) | code, return_inverse=True, return_counts=True)
            keep = tf >= min_tf
            if max_pages is not None:  # a term with more pages here has no fewer in the collection
                keep &= np.bincount(pair & 0xFFFFFFFF, minlength=len(terms))[pair & 0xFFFFFFFF] <= max_pages
            edges = []
            for d in range(1, window):
                near = text[d:] == text[:-d]
                for a, b in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
                    use = near & keep[which[a]]
                    edges.append((which[a][use].astype(np.int64) << 32) | code[b][use])
            edge = np.sort(np.concatenate(edges))
            edge = edge[np.append(True, edge[1:] != edge[:-1])] if len(edge) else edge
            degree = np.bincount(edge >> 32, minlength=len(pair))
            at = np.flatnonzero(keep)
            if len(at):
                ids = block.column(0).take(pa.array(pair[at] >> 32))
                words = terms.take(pa.array((pair[at] & 0xFFFFFFFF).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(tf[at].astype(np.int32)), pa.array(degree[at].astype(np.int32))], names=["page_id", "term", "tf", "degree"])

    return run


def distinctive_terms(bodies: DataFrame, key: str = "page_id", text: str = "page", window: int = WINDOW, min_tf: int = 1, max_pages: int | None = None) -> DataFrame:
    """(page_id, term, tf, degree, pages, score) of every term of every page, or of those that occur ``min_tf`` times in
    the page and in at most ``max_pages`` pages; both limits are applied before the edges are built and again exactly.

    score = degree * ln(1 + all pages / pages).  Rows of ``bodies`` are pages with unique keys; null and empty texts
    count as pages and give no row, nor does an empty table.  A lone term has no neighbour and scores 0.  Frequent terms
    (each with at least 1/HOT_TERMS of all pairs of page and term, so at most HOT_TERMS) get their counts by
    broadcast; the others are joined by term, where no key has more than that share of the rows.
    """
    counts = gram_counts(bodies, text)
    totals = _totals(counts)
    of_terms = counts.where("n = 1 and occurrences >= 0").select("term", "pages")
    ids = bodies.select(F.col(key).alias("page_id"), F.col(text).cast("string").alias("page"))
    schema = f"page_id {ids.schema['page_id'].dataType.simpleString()}, term string, tf int, degree int"
    weights = ids.mapInArrow(_graph_blocks(window, min_tf, max_pages), schema)

    def scored(rows: DataFrame) -> DataFrame:
        score = F.col("degree") * F.log1p(totals["pages"].cast("double") / F.col("pages"))
        return rows.select("page_id", "term", "tf", "degree", "pages", score.alias("score"))

    if max_pages is not None:
        return scored(weights.join(of_terms.where(F.col("pages") <= max_pages), "term"))
    hot: Column = F.col("pages") * HOT_TERMS >= totals["pairs"]
    hot_terms = of_terms.where(hot).select("term", F.col("pages").alias("hot_pages"))
    both = weights.join(F.broadcast(hot_terms), "term", "left")
    frequent = both.where("hot_pages is not null").withColumnRenamed("hot_pages", "pages")
    others = both.where("hot_pages is null").drop("hot_pages").join(of_terms.where(~hot), "term")
    return scored(frequent).unionByName(scored(others))


def keywords(scores: DataFrame, k: int = 10) -> DataFrame:
    """(page_id, rank from 1, term, score) of the ``k`` terms of greatest score of each page; of equal scores (to six
    decimals) the first in the alphabet.  A page's own terms are what one task holds."""
    order = Window.partitionBy("page_id").orderBy(F.desc(F.round("score", 6)), "term")
    top = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("page_id", F.col("rank").cast("int").alias("rank"), "term", F.round("score", 6).alias("score"))
