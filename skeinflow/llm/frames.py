"""Lines that sites repeat: in how many distinct bodies each piece of a line stands, in the collection and in its host.

A line is cut into pieces at separators (bars, colons, arrows, runs of spaces, tags that aren't inline); a piece is
lower-cased, its digits are one sign and its punctuation is dropped.  Menus, notices and footers repeat from page to page
in any language, and text hardly does, so no word lists are needed.  Copies of a body count once: bodies are shuffled by
their digest behind a map-side combine, cut and hashed by Arrow kernels, and what moves then is (hash of a piece, count),
added up by batch before the shuffle.

The workers get the counts as one table.  Pieces that a few bodies share grow with the collection, those that a good share
of it or of a host has only with the number of hosts, so a reader that only asks whether a line is repeated enough gets the
latter (``deciding``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.session import discard, written

#: Fewest distinct bodies that make a piece repeated.
LEAST_BODIES = 3
#: Repeated pieces that are sent to all workers as one table (16 bytes each); beyond it they are joined by their hash.
MOST_SENT = 1_000_000
#: Share of the collection's bodies at which a piece begins to count as repeated, and at which it does in full; the share of
#: its host's bodies at which it does in full.
SHARES, HOST_SHARE = (0.0005, 0.016), 0.25

#: What a page goes through before it is cut: pattern, replacement.
_STEPS = (
    (r"(?i)</?(?:a|abbr|b|cite|code|em|font|i|kbd|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var)(?:\s[^<>\n]*)?>", ""),
    (r"<[^<>\n]*>|&gt;", "\x1f"),
    (r"&#?\w{1,10};", " "),
    (r"\pN+", "0"),
    (r"[ \t\r\f\x{a0}]*[\x1f:|·›»>•][ \t\r\f\x{a0}\x1f:|·›»>•]*|[ \t\r\f\x{a0}]{2,}|\t", "\x1f"),
    (r"[^\pL\pM\pN \n\x1f]+", ""),
)
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?P<h>[^/:?#]*)"


def hosts(urls: pa.Array) -> pa.Array:
    """Hosts of addresses; an empty text where there is none."""
    found = pc.struct_field(pc.extract_regex(urls.cast(pa.string()), _HOST), "h")
    return pc.fill_null(pc.utf8_lower(found), "")


def _hashed(texts: pa.Array) -> np.ndarray:
    coded = texts.dictionary_encode()
    words = np.asarray(coded.dictionary.to_pandas(), object)
    if not len(words):
        return np.zeros(0, np.int64)
    return pd.util.hash_array(words, categorize=False).view(np.int64)[np.asarray(coded.indices)]


def _in_host(h: np.ndarray, host: np.ndarray) -> np.ndarray:
    """Hash of a piece within a host."""
    with np.errstate(over="ignore"):
        return (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ host.view(np.uint64)).view(np.int64)


class Pieces:
    """The pieces of the lines of some pages, in order.

    ``page`` and ``line`` (from 0 within the collection of pages) of each piece, its hash, and whether it has several words;
    ``first_line`` of each page, with the number of all lines at the end; ``host``: the hash of each page's host.
    """

    def __init__(self, pages: pa.Array, urls: pa.Array):
        text = pc.utf8_lower(pc.fill_null(pages.cast(pa.large_string()), ""))
        for pattern, by in _STEPS:
            text = pc.replace_substring_regex(text, pattern, by)
        lines = pc.split_pattern(text, "\n")
        self.first_line = np.asarray(lines.offsets).astype(np.int64) - int(lines.offsets[0].as_py() if len(lines.offsets) else 0)
        each = pc.split_pattern(lines.flatten(), "\x1f")
        flat = pc.utf8_trim(each.flatten(), " ")
        line = np.repeat(np.arange(len(each)), np.diff(np.asarray(each.offsets)))
        some = np.asarray(pc.not_equal(flat, ""))
        flat, self.line = flat.filter(pa.array(some)), line[some]
        self.page = np.searchsorted(self.first_line[1:], self.line, "right")
        self.hash = _hashed(flat)
        self.several_words = np.asarray(pc.match_substring(flat, " "))
        self.host = _hashed(hosts(urls))

    def keys(self) -> np.ndarray:
        """Hashes of the distinct pieces of each page, in the collection and in its host, and of the page itself in both."""
        return self.placed_keys()[0]

    def placed_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``keys``, and of each the page and its host, 0 in the collection.  A host's own key is its hash."""
        pages = np.arange(len(self.host))
        page = np.concatenate([self.page, pages])
        h = np.concatenate([self.hash, np.zeros(len(pages), np.int64)])
        both = np.stack([page, h])
        order = np.lexsort(both[::-1])
        page, h = page[order], h[order]
        new = np.append(True, (page[1:] != page[:-1]) | (h[1:] != h[:-1])) if len(page) else np.zeros(0, bool)
        page, h = page[new], h[new]
        host = self.host[page]
        return np.concatenate([h, _in_host(h, host)]), np.tile(page, 2), np.concatenate([np.zeros_like(host), host])


class Counts:
    """Numbers of bodies by hash, 0 for few: sorted arrays, small enough for every worker."""

    def __init__(self, keys: np.ndarray, bodies: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.bodies = keys[order], bodies[order]

    @classmethod
    def of(cls, pages: list[str], urls: list[str | None], least: int = LEAST_BODIES) -> Counts:
        """Counts over a few pages, all of them different."""
        keys, number = np.unique(Pieces(pa.array(pages, pa.string()), pa.array(urls, pa.string())).keys(), return_counts=True)
        return cls(keys[number >= least], number[number >= least])

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.bodies[at], 0)


def repetition(pages: pa.Array, urls: pa.Array, counts: Counts) -> list[np.ndarray]:
    """Of each page an array with a row for each of its lines, from 0 to 1: repetition of the least repeated piece (in the
    collection or in the host, where it is greater), and in the collection of the first and of the last piece of a line that
    has several (0 for a piece of one word).  A line without pieces has zeros."""
    p = Pieces(pages, urls)
    out = np.zeros((int(p.first_line[-1]), 3))
    if len(p.line):
        whole = max(1, int(counts(np.zeros(1, np.int64))[0]))
        low, high = SHARES
        share = np.clip(np.log(np.maximum(counts(p.hash) / whole, low) / low) / np.log(high / low), 0, 1)
        of_host = counts(_in_host(np.zeros(len(p.host), np.int64), p.host))[p.page]
        own = np.minimum(1, counts(_in_host(p.hash, p.host[p.page])) / np.maximum(of_host, 1) / HOST_SHARE)
        begin = np.flatnonzero(np.append(True, p.line[1:] != p.line[:-1]))
        end = np.append(begin[1:], len(p.line)) - 1
        at, several = p.line[begin], end > begin
        out[at, 0] = np.maximum(np.minimum.reduceat(share, begin), np.minimum.reduceat(own, begin))
        out[at, 1] = share[begin] * (several & p.several_words[begin])
        out[at, 2] = share[end] * (several & p.several_words[end])
    return np.split(out, p.first_line[1:-1]) if len(p.host) else []


def distinct_bodies(pages: DataFrame, text: str = "page", url: str = "url") -> DataFrame:
    """(page, url) of each distinct body, with the least of its addresses; null and blank pages are left out."""
    src = pages.select(F.col(text).cast("string").alias("page"), F.col(url).cast("string").alias("url")).where("trim(page) <> ''")
    return src.groupBy(F.md5(F.col("page").cast("binary")).alias("k")).agg(F.min("page").alias("page"), F.min("url").alias("url")).select("page", "url")


def counted(bodies: DataFrame, least: int = LEAST_BODIES) -> DataFrame:
    """(h, bodies): hashes of pieces that at least ``least`` of the bodies (page, url) have.  Each body counts once for a
    piece, and batches are added up before the shuffle, so no hash has more rows than there are batches."""
    return counted_by_host(bodies, least).select("h", "bodies")


def counted_by_host(bodies: DataFrame, least: int = LEAST_BODIES) -> DataFrame:
    """(h, host, bodies): ``counted`` with the hash of the host that it was counted in, 0 in the collection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                every, _, host = Pieces(part.column(0), part.column(1)).placed_keys()
                keys, first, number = np.unique(every, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(host[first]), pa.array(number.astype(np.int64))], names=["h", "host", "bodies"])

    each = bodies.mapInArrow(run, "h long, host long, bodies long")
    return each.groupBy("h").agg(F.max("host").alias("host"), F.sum("bodies").alias("bodies")).where(F.col("bodies") >= least)


def deciding(counts: DataFrame, enough: float) -> DataFrame:
    """(h, bodies) of the ``counted_by_host`` pieces whose repetition is at least ``enough``, and of all hosts and the
    collection itself.  With these alone ``repetition`` is at least ``enough`` in the same places, in each of its columns.
    Each body has few pieces, so however many bodies a host has, few pieces can be in such a share of them."""
    low, high = SHARES
    nearly = 1 - 1e-9  # rounding keeps a piece rather than drops it
    whole = counts.where("host = 0 and h = 0").first()
    in_all = counts.where((F.col("host") == 0) & (F.col("bodies") >= (whole["bodies"] if whole else 0) * low * (high / low) ** enough * nearly))
    of_host = counts.where("host <> 0 and h = host").select("host", F.col("bodies").alias("all"))
    in_host = counts.where("host <> 0").join(of_host, "host").where(F.col("bodies") >= F.col("all") * (enough * HOST_SHARE * nearly))
    return in_all.select("h", "bodies").unionAll(in_host.select("h", "bodies"))


def joined_counts(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """``pages`` (k, page, url) with ``hs`` and ``ns``: the repeated hashes of the page's own pieces and their bodies, by a
    join on the hash.  A page has each hash once, so among all rows a hash has at most one of those of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys, page, _ = Pieces(part.column(1), part.column(2)).placed_keys()
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(page)), pa.array(keys)], names=["k", "h"])

    each = pages.select("k", "page", "url").mapInArrow(run, f"k {pages.schema['k'].dataType.simpleString()}, h long").distinct()
    found = each.join(counts, "h").groupBy("k").agg(F.collect_list(F.struct("h", "bodies")).alias("r"))
    return pages.join(found, "k", "left").select(*pages.columns, F.col("r.h").alias("hs"), F.col("r.bodies").alias("ns"))


class SentCounts:
    """Counts for the workers: as one table where there are at most ``most``, else through ``joined_counts``.  A reader that
    only asks where repetition is at least ``enough`` gives that and ``counted_by_host``, and gets the ``deciding`` ones."""

    def __init__(self, spark: SparkSession, counts: DataFrame, most: int = MOST_SENT, enough: float = 0.0):
        kept = written(counts, "frames")
        if enough > 0:
            every, kept = kept, written(deciding(kept, enough), "frames")
            discard(every)
        if kept.count() > most:
            self.table, self.rows = None, kept
            return
        table = kept.toArrow()
        discard(kept)
        self.rows = None
        self.table = spark.sparkContext.broadcast((np.asarray(table.column("h")), np.asarray(table.column("bodies"))))

    def beside(self, pages: DataFrame) -> DataFrame:
        """``pages`` (k, page, url), with their counts where these come by a join."""
        return pages if self.rows is None else joined_counts(pages, self.rows)

    @staticmethod
    def reader(table):
        """A function that gives the repetition of the lines of each page of a batch (k, page, url[, hs, ns])."""
        sent = Counts(*table.value) if table is not None else None

        def read(batch: pa.RecordBatch) -> list[np.ndarray]:
            if sent is not None:
                return repetition(batch.column(1), batch.column(2), sent)
            out = []
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                # a hash has the same number in all pages, so those of many pages are one table
                hs, ns = (np.asarray(part.column(c).flatten(), np.int64) for c in (3, 4))
                hs, first = np.unique(hs, return_index=True)
                out += repetition(part.column(1), part.column(2), Counts(hs, ns[first]))
            return out

        return read
