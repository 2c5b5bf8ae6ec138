"""Keyword-stuffed, tag and link-list pages.

A page's own content (without containers named as frames, and without the lines that repeat over the collection or the
host, see ``frames``) is cut into blocks of some hundred characters.  Of each block two compression ratios are measured: of
its words, which repeated keywords make small whatever they are dressed as, and of its shape (words of up to three letters
stay, other words become one sign, numbers and addresses another), which lists of tags and links make small.  Both are
divided by the ratio that text of this length and script has.  A block is stuffed if its words are extremely redundant, or
if its words or its shape are redundant and a low density of sentences confirms it.  A page is stuffed if most words of its
own content are in such blocks.  There are no word lists, and nothing depends on the language but the curve of its script.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm.boilerplate import Lines
from skeinflow.llm.frames import MOST_SENT, SentCounts, counted_by_host, distinct_bodies

#: Compression ratio of text by script, of its words and of its shape: at 400 bytes, and what it falls by with each doubling
#: of the length; fitted by ``fit_curve`` to the blocks of crawled pages (Latin) and to documents (see the README).  Scripts
#: without texts to fit have the last, which is below all others.
CURVES = {
    "latin": ((0.544, 0.072), (0.371, 0.086)),
    "cyrillic": ((0.442, 0.124), (0.193, 0.117)),
    "han": ((0.518, 0.133), (0.185, 0.066)),
    "arabic": ((0.384, 0.122), (0.297, 0.147)),
    "devanagari": ((0.29, 0.083), (0.324, 0.084)),
    "other": ((0.29, 0.133), (0.185, 0.147)),
}
#: Redundancy of words, relative to plain text, that is enough by itself; that is with few sentences; redundancy of shape
#: that is with hardly any.  FEW and HARDLY are shares of a block's bytes that stand in sentences.
WORDS, WORDS_CONFIRMED, SHAPE_CONFIRMED, FEW, HARDLY = 0.65, 0.8, 0.75, 0.2, 0.1
#: Characters of a block; of one that ends at a container's edge; share of words in stuffed blocks that makes a page
#: stuffed; least bytes of a sentence; repetition from which a line is of the frame, and that of a short line's beginning;
#: characters of a line that is content in a frame's container too.
BLOCK_CHARS, EDGE_CHARS, MOST, SENTENCE_BYTES, REPEATED, LONG_LINE = 500, 250, 0.5, 30, 0.5, 600

#: Pages shorter than this are kept with their share, the last 512 of a worker.
KEPT_CHARS = 16_000

_WORD = re.compile(r"https?://\S+|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]")
_LETTERS, _ADDRESS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*"), re.compile(r"https?://\S+")
_ENDS = re.compile("[.!?…]+[\"'”’»)\\]]*(?=\\s|$)|[。！？।؟]+")
_DIGITS = re.compile(r"\d+")
#: An address in angle brackets is text, not a tag.
_AUTOLINK = re.compile(r"<(https?://[^<>\s]+)>", re.I)
_SCRIPTS = (("cyrillic", re.compile("[Ѐ-ԯ]")), ("han", re.compile("[぀-ヿ㐀-鿿]")), ("arabic", re.compile("[؀-ۿ]")), ("devanagari", re.compile("[ऀ-ॿ]")), ("other", re.compile("[^\\W\\d_\u0000-ɏḀ-ỿ]")))


class _Signs(dict):
    """Sign of each token, kept for the tokens seen last: short words and punctuation stand for themselves, other words are
    W, numbers 0, addresses U."""

    def __missing__(self, token: str) -> str:
        if len(self) > 100_000:
            self.clear()
        first = token[0]
        sign = "U" if token.startswith("http") else "0" if first.isdigit() else token if not first.isalpha() or len(token) < 4 else "W"
        self[token] = sign
        return sign


_SIGN = _Signs().__getitem__


def script(text: str) -> str:
    """The script of most letters of a text, of those that have a curve."""
    if text.isascii():
        return "latin"
    for name, letters in _SCRIPTS:
        if len(letters.findall(text)) * 3 > len(text):
            return name
    return "latin"


def ratio(data: bytes) -> float:
    """Compression ratio; the stream's own bytes don't count.  A window of 2 KB holds a block and is quick to set up."""
    return (len(zlib.compress(data, 6, -11)) - 5) / len(data) if data else 1.0


def fit_curve(sizes: np.ndarray, ratios: np.ndarray) -> tuple[float, float]:
    """(ratio at 400 bytes, fall with each doubling): robust line through texts of one script."""
    x = np.stack([np.ones(len(sizes)), -np.log2(np.maximum(sizes, 100) / 400)], axis=1)
    weight = np.ones(len(sizes))
    for _ in range(8):
        at = np.linalg.lstsq(x * weight[:, None], ratios * weight, rcond=None)[0]
        weight = 1 / np.sqrt(np.maximum(np.abs(ratios - x @ at), 0.02))
    return round(float(at[0]), 3), round(float(at[1]), 3)


def _relative(value: float, size: int, curve: tuple[float, float]) -> float:
    return value / max(0.12, curve[0] - curve[1] * log2(max(size, 100) / 400))


def _sentences(low: str) -> tuple[str, float]:
    """(what is measured of a lower-cased block, share of its bytes that stand in sentences): a paragraph given twice is no
    keyword, so of one that is mostly sentences each counts once, unless there are very many of each."""
    ones: list[str] = []
    inside = last = 0
    for m in _ENDS.finditer(low):
        one = low[last : m.start()].rpartition("\n")[2].strip()  # a sentence is of one line
        last = m.end()
        ones.append(one)
        size = len(one) + 1 if one.isascii() else len(one.encode()) + 1
        inside += size if size >= SENTENCE_BYTES else 0
    share = inside / max(1, len(low.encode()))
    if share > 0.5 and len(ones) > 1:
        distinct = dict.fromkeys(_DIGITS.sub("0", x) for x in ones)
        if len(distinct) < len(ones) < 3 * len(distinct):
            low = ". ".join(distinct)
    return low, share


def _words(low: str) -> list[str]:
    return _LETTERS.findall(_ADDRESS.sub(" ", low) if "http" in low else low)


def _shape(low: str) -> bytes:
    signs = list(map(_SIGN, _WORD.findall(low)))
    return " ".join(signs).encode()


def raw_figures(block: str) -> tuple[int, int, float, int, float, float]:
    """(words, bytes and ratio of the words, bytes and ratio of the shape, share of the bytes in sentences) of a block."""
    low, share = _sentences(block.lower())
    words, shape = _words(low), _shape(low)
    plain = " ".join(words).encode()
    return len(words), len(plain), ratio(plain), len(shape), ratio(shape), share


def measured(block: str) -> tuple[int, bool]:
    """(words, whether it is stuffed) of a block; one without words counts by its tokens.

    Redundancies are relative to text of the length and script: 1 is plain, 0 all repetition.  The shape is looked at where
    it can decide.
    """
    low, inside = _sentences(block.lower())
    words = _words(low)
    of_words, of_shape = CURVES[script(block)]
    if words:
        plain = " ".join(words).encode()
        redundancy = _relative(ratio(plain), len(plain), of_words)
        if redundancy < WORDS or redundancy < WORDS_CONFIRMED and inside < FEW:
            return len(words), True
        if inside >= HARDLY:
            return len(words), False
    shape = _shape(low)
    if not words:
        # bare addresses have their shape only; figures and rules are no list of links
        links = shape.count(b"U")
        if not links or links < shape.count(b"0"):
            return shape.count(b" ") + 1 if shape else 0, False
    return len(words) or shape.count(b" ") + 1, _relative(ratio(shape), len(shape), of_shape) < SHAPE_CONFIRMED


def own_blocks(page: str, repeated: np.ndarray | None = None, size: int = BLOCK_CHARS) -> list[str]:
    """Blocks of the visible lines that aren't of the site's frame; no block goes over a container's edge.  ``repeated`` has
    the repetition of each line of the page (see ``frames.repetition``)."""
    lines = Lines(_AUTOLINK.sub(r" \1 ", page), bare=True)
    framed = [False] * len(lines.parents)
    for k in range(1, len(framed)):  # a container stands before those in it
        framed[k] = lines.hints[k] < 0 or framed[lines.parents[k]] and lines.hints[k] == 0
    keep = np.ones(len(lines.text), bool)
    if repeated is not None and len(keep):
        rows = repeated[np.array(lines.number) - 1]
        keep = (rows[:, 0] < REPEATED) & ((rows[:, 1] < REPEATED) | (np.array([len(t) for t in lines.text]) > 150))
    out: list[str] = []
    part: list[str] = []
    chars, container = 0, -1
    for text, inside, hint, linked, wanted in zip(lines.text, lines.inside, lines.hint, lines.linked, keep.tolist(), strict=True):
        if not wanted or (framed[inside] or hint < 0) and len(text) < LONG_LINE or linked and text[-1] == "…":
            continue
        if part and (inside != container and chars >= EDGE_CHARS or len(text) > size):
            out.append("\n".join(part))
            part, chars = [], 0
        container = inside
        while len(text) > 2 * size:  # a long line is cut at a space
            at = text.rfind(" ", 1, size)  # not the space that a rest begins with
            at = size if at < 0 else at
            out.append("\n".join([*part, text[:at]]))
            part, chars, text = [], 0, text[at:]
        part.append(text)
        chars += len(text) + 1
        if chars >= size:
            out.append("\n".join(part))
            part, chars = [], 0
    if part:
        out.append("\n".join(part))
    return out


def stuffed_share(page: str | None, repeated: np.ndarray | None = None) -> float | None:
    """Share of the words of a page's own content that stand in stuffed blocks, of all its content where all of it is of the
    frame; null where there is no text."""
    if not page or page.isspace():
        return None
    figures = [measured(b) for b in own_blocks(page, repeated)] or [measured(b) for b in own_blocks(page)]
    words = sum(n for n, _ in figures)
    return sum(n for n, stuffed in figures if stuffed) / words if words else None


def stuffed_shares(pages: DataFrame, key: str = "page_id", text: str = "page", url: str = "url", most_sent: int = MOST_SENT) -> DataFrame:
    """(key, share double): ``stuffed_share`` of each key; null for null and blank pages.

    What repeats is counted over all the pages, in distinct bodies; that job runs when this is called.  Only whether a
    line's repetition is at least REPEATED matters here, so the workers get the pieces that decide it.  Repeated rows of a
    key count once; should its pages differ, the least share is taken.  Pages are measured where they are read, and only
    keys and shares are shuffled.  Other columns, whatever their names, are not read.
    """
    src = pages.select(F.col(key).alias("k"), F.col(text).cast("string").alias("page"), F.col(url).cast("string").alias("url"))
    counts = SentCounts(src.sparkSession, counted_by_host(distinct_bodies(pages, text, url)), most_sent, REPEATED)
    table = counts.table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = SentCounts.reader(table)
        kept: dict[tuple[str, bytes], float | None] = {}
        for batch in batches:
            shares = []
            for page, repeated in zip(batch.column(1).to_pylist(), read(batch), strict=True):
                if page and len(page) < KEPT_CHARS:  # a short page may be one of many copies
                    one = (page, repeated.tobytes())
                    if one not in kept:
                        if len(kept) >= 512:
                            kept.pop(next(iter(kept)))
                        kept[one] = stuffed_share(page, repeated)
                    shares.append(kept[one])
                else:
                    shares.append(stuffed_share(page, repeated))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], names=["k", "share"])

    each = counts.beside(src.distinct() if table is None else src).mapInArrow(run, T.StructType([src.schema["k"], T.StructField("share", T.DoubleType())]))
    return each.groupBy("k").agg(F.min("share").alias("share")).withColumnRenamed("k", key)
