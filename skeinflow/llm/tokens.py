"""Encoding with a public byte-level BPE vocabulary.

A rank file (base64 of a token's bytes, its rank) is written out as a sentencepiece BPE model: piece ``r`` is the token
of rank ``r`` with each byte mapped to one printable character, its score ``-r``, normalisation the identity.  Merging
the pair of highest score is then merging the pair of lowest rank.  Texts are cut into pre-tokens by the vocabulary's
pattern; the distinct pre-tokens of a block are encoded once and their ids gathered.  Decoding maps ids back to bytes.

Null and empty texts have no ids.  Special tokens are not part of a rank file, so text that looks like one is text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Place of the vocabulary files; a parameter of every operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern of pre-tokens of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text whose pre-tokens are gathered at once.
BLOCK_CHARS = 2_000_000
#: Pre-tokens whose ids a worker keeps, and characters of the longest of them.
MOST_KEPT, LONGEST_KEPT = 150_000, 24


def byte_characters() -> str:
    """The character of each byte: printable Latin-1 ones stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(spare)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while True:
        out.append((n & 127) | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks must be 0 to {len(ranks) - 1}")
    return [ranks[r] for r in range(len(ranks))]


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model (protocol buffer) whose piece ids are the ranks; the unknown piece comes after them."""
    names = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(names[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))  # BPE, size, id of unknown
    trainer += b"".join(_field(n, -1) for n in (41, 42, 43)) + _field(24, 0)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Codec:
    """Encoder and decoder of one vocabulary; one for each worker process."""

    def __init__(self, model: bytes, tokens: list[bytes] | None = None, pattern: str = PATTERN):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.names = {b: c for b, c in enumerate(byte_characters())}
        back = {c: b for b, c in self.names.items()}
        n = self.pieces.get_piece_size() - 1
        self.tokens = tokens or [bytes(back[c] for c in self.pieces.id_to_piece(i)) for i in range(n)]
        self.known: dict[str, list[int]] = {}
        self.lengths: dict[str, int] = {}
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text)."""
        flat: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                before = len(flat)
                flat += self.cut(t)
                counts[i] = len(flat) - before
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        which = np.asarray(coded.indices)
        lists = self._encode_words(coded.dictionary.to_pylist())
        size = np.array([len(x) for x in lists], np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        ids = np.fromiter((i for x in lists for i in x), np.int32, count=int(start[-1]))
        each = size[which]
        at = np.cumsum(each) - each
        out = ids[np.repeat(start[which] - at, each) + np.arange(int(each.sum()))]
        text_end = np.concatenate([[0], np.cumsum(each)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return out, text_end[ends]

    def count_many(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text, without the ids: quicker for few texts; for many, ``encode_many`` is."""
        lists = [self.cut(t) if t else [] for t in texts]
        of = self.lengths
        new = list({w for words in lists for w in words if w not in of})
        if new:
            sizes = dict(zip(new, map(len, self._encode_words(new)), strict=True))
            short = {w: n for w, n in sizes.items() if len(w) <= LONGEST_KEPT}
            if len(of) + len(short) > MOST_KEPT:  # those of these texts stay
                of = self.lengths = {w: of[w] for words in lists for w in words if w in of}
            of.update(short)
            if len(short) < len(sizes):
                of = ChainMap(sizes, of)
        return np.array([sum(map(of.__getitem__, words)) for words in lists], np.int64)

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct pre-tokens; those of short ones are kept for later blocks."""
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            lists = self.pieces.encode([w.encode().decode("latin-1").translate(self.names) for w in new], num_threads=1)
            if len(known) + len(new) > MOST_KEPT:
                known.clear()
                return self._encode_words(words) if len(new) < len(words) else lists
            long = {w: x for w, x in zip(new, lists, strict=True) if len(w) > LONGEST_KEPT}
            known.update((w, x) for w, x in zip(new, lists, strict=True) if len(w) <= LONGEST_KEPT)
            if long:
                return [long[w] if w in long else known[w] for w in words]
        return [known[w] for w in words]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 (parts of a character at the ends) become U+FFFD."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


_CODECS: dict[bytes, Codec] = {}


def worker_codec(model: bytes) -> Codec:
    """The codec of this process, built at the first call."""
    digest = hashlib.sha1(model).digest()
    if digest not in _CODECS:
        _CODECS[digest] = Codec(model)
    return _CODECS[digest]


@lru_cache(maxsize=4)
def _model_file(path: str) -> bytes:
    return serialise_model(read_ranks(path))


def broadcast_model(spark: SparkSession, vocabulary: str = VOCABULARY):
    """The serialised vocabulary on every executor; its size is that of the vocabulary (about 1 MB), never of the data."""
    return spark.sparkContext.broadcast(_model_file(vocabulary))


def text_blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = np.asarray(pc.fill_null(pc.utf8_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    i = 0
    while i < batch.num_rows:
        done = ends[i - 1] if i else 0
        j = min(batch.num_rows, max(i + 1, int(np.searchsorted(ends, done + BLOCK_CHARS, "right"))))
        yield batch.slice(i, j - i)
        i = j


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of each row; null and empty texts have an empty list, repeated rows come out repeated.

    No shuffle; other columns, whatever their names, are not read.
    """
    model = broadcast_model(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model.value)
        for batch in batches:
            for block in text_blocks(batch, 1):
                ids, offsets = codec.encode_many(block.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([block.column(0), lists], names=["k", "ids"])

    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = T.StructType([src.schema["k"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema).withColumnRenamed("k", key)


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """The other columns of df and the number of tokens of ``text`` (0 for null), without the text."""
    model = broadcast_model(df.sparkSession, vocabulary)
    rest = [c for c in df.columns if c != text]
    src = df.select(*rest, F.col(text).cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model.value)
        for batch in batches:
            for block in text_blocks(batch, len(rest)):
                _, offsets = codec.encode_many(block.column(len(rest)).to_pylist())
                yield pa.RecordBatch.from_arrays([*block.columns[: len(rest)], pa.array(np.diff(offsets))], names=[*rest, name])

    schema = T.StructType([*(src.schema[c] for c in rest), T.StructField(name, T.LongType())])
    return src.mapInArrow(run, schema)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of each row's ids; null and empty lists give an empty text."""
    model = broadcast_model(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model.value)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    src = df.select(F.col(key).alias("k"), F.col(ids).alias("i"))
    schema = T.StructType([src.schema["k"], T.StructField("text", T.StringType())])
    return src.mapInArrow(run, schema).withColumnRenamed("k", key)
