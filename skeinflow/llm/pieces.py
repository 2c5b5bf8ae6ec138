"""Oversized documents cut into pieces at natural boundaries, by recursive bisection.

A document with more tokens than its limit is cut at the strongest boundary near its midpoint: the end of a paragraph,
else of a line, else of a sentence; where the middle half has none of these the whole span is searched, and only then
words and bare token boundaries serve.  Halves that still exceed limit minus overlap are cut again.  Then each piece but
the first gets the tokens before it as overlap.  Cuts lie on boundaries of tokens and characters, so the pieces without
their overlaps join to the text.  Each piece is encoded by itself for the check of the limit, as a cut changes the tokens
beside it; if it is too long it is cut again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm.mix import canonical
from skeinflow.llm.tokens import VOCABULARY, Codec, broadcast_model, text_blocks, worker_codec

PARAGRAPH, LINE, SENTENCE, WORD, TOKEN = 5, 4, 3, 2, 1
_IS_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
#: A run of signs is looked at once: it begins where no other of them stands before, and nothing of it is given back.
_SENTENCE_END = regex.compile(r"(?<![.!?…])[.!?…]++[\"'”’»)\]]*+(?=\s)|[。！？｡।؟]+[”’」』）]*")


def boundary_strengths(text: str) -> np.ndarray:
    """Strength of a cut before each character (and at the end) of text; 0 where nothing natural is."""
    n = len(text)
    out = np.zeros(n + 1, np.int8)
    if n == 0:
        return out
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = _IS_SPACE[np.minimum(codes, len(_IS_SPACE) - 1)]
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    out[:n][begins] = WORD
    ends = np.fromiter((m.end() for m in _SENTENCE_END.finditer(text)), np.int64)
    if len(ends):  # before the white space after a sentence, and after it
        solid = np.append(np.flatnonzero(~space), n)
        out[ends] = SENTENCE
        out[solid[np.searchsorted(solid, ends)]] = SENTENCE
    feeds, returns = codes == 10, codes == 13
    if feeds.any() or returns.any():
        # runs of white space with a line's end: one cut after the last end, one after the whole run
        first = np.flatnonzero(begins)
        after = np.append(np.flatnonzero(space[:-1] & ~space[1:]) + 1, n) if space[-1] else np.flatnonzero(space[:-1] & ~space[1:]) + 1
        number = np.stack([np.add.reduceat(feeds, first), np.add.reduceat(returns, first)]).max(axis=0)
        last = np.maximum.reduceat(np.where(feeds | returns, np.arange(n), -1), first)
        strength = np.where(number > 1, PARAGRAPH, LINE).astype(np.int8)
        some = number > 0
        out[last[some] + 1] = strength[some]
        out[after[some]] = strength[some]
    return out


class _Document:
    def __init__(self, codec: Codec, text: str, ids: np.ndarray):
        self.codec, self.text = codec, text
        ends = np.concatenate([[0], np.cumsum(codec.sizes[ids])])
        raw = np.frombuffer(text.encode(), np.uint8)
        starts = (raw & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(starts)])
        clean = np.append(starts, True)[ends]
        self.char = np.where(clean, before[ends], -1)  # character at each token boundary, -1 inside a character
        strength = boundary_strengths(text)
        self.strength = np.where(clean, np.maximum(strength[np.maximum(self.char, 0)], TOKEN), 0)
        self.n = len(ids)

    def cut(self, a: int, b: int) -> int | None:
        """The token boundary to cut a..b at."""
        inner = np.arange(a + 1, b)
        s = self.strength[a + 1 : b]
        if not (s > 0).any():
            return None
        middle, quarter = (a + b) / 2, (b - a) / 4
        near = np.abs(inner - middle) <= quarter
        for scope in (near, np.ones(len(inner), bool)):
            if (s[scope] >= SENTENCE).any():
                best = s[scope].max()
                at = inner[scope & (s == best)]
                return int(at[np.argmin(np.abs(at - middle))])
        scope = near if (s[near] > 0).any() else np.ones(len(inner), bool)
        best = s[scope].max()
        at = inner[scope & (s == best)]
        return int(at[np.argmin(np.abs(at - middle))])

    def part(self, a: int, b: int) -> str:
        return self.text[self.char[a] : self.char[b]]


def split_document(codec: Codec, text: str, ids: np.ndarray, limit: int, overlap: int) -> list[str]:
    """Pieces of at most ``limit`` tokens, each beginning with the last ``overlap`` tokens of what was before it."""
    return [text[a:b] for a, _, b, _ in split_spans(codec, text, ids, limit, overlap)]


def split_spans(codec: Codec, text: str, ids: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(first character with the overlap, without it, end, tokens) of each piece."""
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    doc = _Document(codec, text, ids)

    def bisect(spans: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
        out, stack = [], spans[::-1]
        while stack:
            a, b = stack.pop()
            at = doc.cut(a, b) if b - a > room else None
            if at is None:  # short enough, or one character only
                out.append((a, b))
            else:
                stack += [(at, b), (a, at)]
        return out

    def begin(places: list[int]) -> list[int]:
        """Token boundaries at which the overlaps before these places begin: an overlap's text by itself has ``overlap``
        tokens, if any choice near by has."""
        if overlap == 0:
            return places
        first = [max(0, a - overlap) for a in places]
        sizes = codec.count_many([doc.part(x, a) if doc.char[x] >= 0 else None for x, a in zip(first, places, strict=True)])
        out = list(first)
        open_ = {i for i, (a, n) in enumerate(zip(places, sizes, strict=True)) if n != overlap and a > 0}
        closest = {i: first[i] for i in open_ if doc.char[first[i]] >= 0}
        for d in range(1, 9):  # the nearest first, of all places at once
            tries = [(i, x) for i in sorted(open_) for x in (first[i] - d, first[i] + d) if 0 <= x < places[i] and doc.char[x] >= 0]
            if not tries:
                continue
            for (i, x), k in zip(tries, codec.count_many([doc.part(x, places[i]) for i, x in tries]), strict=True):
                closest.setdefault(i, x)
                if k == overlap and i in open_:
                    out[i] = x
                    open_.discard(i)
        for i in open_:
            out[i] = closest.get(i, places[i])
        return out

    #: (beginning with the overlap, without it, end, tokens or None where it has to be encoded)
    spans: list[tuple[int, int, int, int | None]] = []
    parts = bisect([(0, doc.n)], max(1, limit - overlap))
    for s, (a, b) in zip(begin([a for a, _ in parts]), parts, strict=True):
        spans.append((s, a, b, None))
    while True:
        new = [i for i, x in enumerate(spans) if x[3] is None]
        for i, n in zip(new, codec.count_many([doc.part(spans[i][0], spans[i][2]) for i in new]), strict=True):
            spans[i] = (*spans[i][:3], int(n))
        if all(x[3] <= limit for x in spans):
            break
        again: list[tuple[int, int, int, int | None]] = []
        stuck = True
        for s, a, b, n in spans:
            if n <= limit:
                again.append((s, a, b, n))
                continue
            halves = bisect([(a, b)], max(1, (b - a) - 1 - max(0, n - limit - 1)))
            if len(halves) > 1:
                stuck = False
                begins = [s, *begin([x for x, _ in halves[1:]])]
                again += [(s2, x, y, None) for s2, (x, y) in zip(begins, halves, strict=True)]
            elif s < a:  # one token of text, or one character: shorten the overlap instead
                stuck = False
                s += 1
                while s < a and doc.char[s] < 0:
                    s += 1
                again.append((s, a, b, None))
            else:
                again.append((s, a, b, n))  # a single character of more tokens than the limit
        spans = again
        if stuck:
            break
    return [(int(doc.char[s]), int(doc.char[a]), int(doc.char[b]), int(n)) for s, a, b, n in spans]


def with_limits(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """(doc_id, text, max_tokens, overlap_tokens): the limits of the document's source, those of ``*`` for a null source
    and for one without limits.  Spellings of a source are one; of several limits the least holds."""
    own = limits.select(canonical(F.col("source")).alias("s"), F.struct(F.col("max_tokens").cast("int").alias("m"), F.col("overlap_tokens").cast("int").alias("o")).alias("l"))
    own = own.where("s is not null and l.m is not null").groupBy("s").agg(F.min("l").alias("l"))
    rest = own.where("s = '*'").select("l")
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"), canonical(F.col("source")).alias("s"))
    joined = docs.join(own.where("s <> '*'"), "s", "left").withColumn("l", F.coalesce(F.col("l"), rest.scalar()))
    return joined.select("doc_id", "text", F.col("l.m").alias("max_tokens"), F.coalesce(F.col("l.o"), F.lit(0)).alias("overlap_tokens"))


def split_oversized(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, number, text, n_tokens) of each piece of each document with more tokens than its source's limit.

    ``number`` counts from 1.  Null, empty and short texts give no row, nor do documents without any limit; repeated
    rows give repeated pieces; other columns are not read.  A limit below the tokens of one character can't be kept;
    then that character is a piece.
    """
    model = broadcast_model(documents.sparkSession, vocabulary)
    src = with_limits(documents, limits).where("text is not null and max_tokens is not null").where("octet_length(text) > max_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model.value)
        for batch in batches:
            for block in text_blocks(batch, 1):
                texts = block.column(1).to_pylist()
                ids, offsets = codec.encode_many(texts)
                limit, overlap = block.column(2).to_pylist(), block.column(3).to_pylist()
                at, number, out, size = [], [], [], []
                for i, t in enumerate(texts):
                    own = ids[offsets[i] : offsets[i + 1]]
                    if len(own) > limit[i]:
                        spans = split_spans(codec, t, own, limit[i], overlap[i])
                        at += [i] * len(spans)
                        number += range(1, len(spans) + 1)
                        out += [t[a:b] for a, _, b, _ in spans]
                        size += [n for *_, n in spans]
                if at:
                    yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(at)), pa.array(number, pa.int32()), pa.array(out, pa.string()), pa.array(size, pa.int32())], names=["doc_id", "number", "text", "n_tokens"])

    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("number", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.IntegerType())])
    return src.mapInArrow(run, schema)
