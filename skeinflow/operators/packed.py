"""Several values packed in one field: one row per link, with its position.

The field of a row holds links separated by any of ``, ; | ^ ~`` and white space, in any mixture, some of them in
double or single quotes (a doubled quote is a quote inside), or the whole as a bracketed list, there with backslash
escapes.  The splitter scans the Arrow string buffer of a batch as one byte array: quote parity and delimiter masks are
computed for all rows at once, child offsets are derived from them, and the list array is flattened with the ordinal of
its parent.  Rows whose quoting is not regular (an open quote, a quote inside a bare value, escapes other than
``\\/ \\" \\\\``) take a sequential scanner of the same rules; it is exact for every row and the reference of the tests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose bytes are scanned at once; small enough for the processor's cache.
BLOCK_ROWS = 1000
SPACE = b" \t\n\r\x0b\x0c"
DELIMITERS = b",;|^~"
_SPACE, _CUT = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[list(SPACE)] = True
_CUT[list(SPACE + DELIMITERS)] = True
_JSON_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


_MARKS = {c: re.compile(c) for c in "\"'"}
_MARKS_IN_LIST = {c: re.compile(f"[{c}\\\\]") for c in "\"'"}
_RUNS = {c: re.compile(f"{c}+") for c in "\"'"}


def _same(body: str, at: int) -> int:
    """Where the run of the quote at this place ends."""
    return _RUNS[body[at]].match(body, at).end()


def _is_link(s: str) -> bool:
    return s.startswith(("/", "http://", "https://"))


def _unescape(s: str) -> str:
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if c == "\\" and i + 1 < len(s):
            n = s[i + 1]
            if n == "u" and len(h := s[i + 2 : i + 6]) == 4 and all(x in "0123456789abcdefABCDEF" for x in h):
                code = int(h, 16)
                out.append("�" if 0xD800 <= code < 0xE000 else chr(code))
                i += 6
                continue
            out.append(_JSON_ESCAPES.get(n, n))
            i += 2
            continue
        out.append(c)
        i += 1
    return "".join(out)


def split_one(text: str | None) -> list[str]:
    """Links of one field, left to right: the sequential form of the rules."""
    if text is None:
        return []
    cut, space = (SPACE + DELIMITERS).decode(), SPACE.decode()
    body = text.strip(space)
    bracketed = len(body) > 1 and body[0] == "[" and body[-1] == "]"
    if bracketed:
        body = body[1:-1]
    out, i, n = [], 0, len(body)
    runs: dict[int, int] = {}  # ends of runs of one quote, by where they were entered
    while i < n:
        c = body[i]
        if c in cut:
            i += 1
            continue
        if c in "\"'":
            j, close = i + 1, -1
            mark = (_MARKS_IN_LIST if bracketed else _MARKS)[c]
            while m := mark.search(body, j):
                j = m.start()
                if body[j] == "\\":
                    j += 2
                    continue
                run = runs.get(j)
                if run is None:
                    run = runs[j] = _same(body, j)
                if (run - j) % 2:  # the last of an odd run closes
                    close = run - 1
                    break
                j = run
            if close >= 0 and (close + 1 == n or body[close + 1] in cut):
                inner = body[i + 1 : close].replace(c * 2, c)
                inner = (_unescape(inner) if bracketed else inner).strip(space)
                if _is_link(inner):
                    out.append(inner)
                i = close + 1
                continue
            i += 1  # a stray quote: what follows is a bare value
            continue
        # a bare value ends at white space, or at delimiters before the next link, a quote or the end
        j = i
        while j < n and body[j] not in space:
            if body[j] in cut:
                k = j
                while k < n and body[k] in cut:
                    k += 1
                if k == n or body[k] in "\"'" or _is_link(body[k : k + 8]) or any(x in space for x in body[j:k]):
                    break
                j = k
                continue
            j += 1
        value = body[i:j]
        if bracketed:
            value = _unescape(value)
        if _is_link(value):
            out.append(value)
        i = j
    return out


def _starts_with(b: np.ndarray, at: np.ndarray, what: bytes) -> np.ndarray:
    ok = at + len(what) <= len(b)
    for k, c in enumerate(what):
        ok &= b[np.minimum(at + k, len(b) - 1)] == c
    return ok


def split_batch(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(parent ordinal of each link, links) of a string column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64, count=n + 1 + col.offset)[col.offset :] if n else np.zeros(1, np.int64)
    data = col.buffers()[2] if n else None
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if col.null_count:  # a null may own bytes
        valid = np.asarray(col.is_valid())
    else:
        valid = np.ones(n, bool)
    size = len(raw)
    if size == 0:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    b = raw.copy()
    lens = np.diff(off)
    row = np.repeat(np.arange(n), lens)
    idx = np.arange(size)

    # outer brackets of a list become white space
    solid = np.flatnonzero(~_SPACE[b])
    if len(solid) == 0:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    lo = np.searchsorted(solid, off[:-1])
    hi = np.searchsorted(solid, off[1:]) - 1
    has = hi > lo
    first, last = solid[np.minimum(lo, len(solid) - 1)], solid[np.maximum(hi, 0)]
    bracketed = has & (b[first] == 91) & (b[last] == 93) & valid
    b[first[bracketed]] = 32
    b[last[bracketed]] = 32
    irregular = np.zeros(n, bool)

    # escapes, in bracketed rows only
    back = (b == 92) & bracketed[row]
    escaper = np.zeros(size, bool)
    if back.any():
        run = idx - np.maximum.accumulate(np.where(back, -1, idx))  # length of the run of backslashes that ends here
        escaper = back & (run % 2 == 1)
        at = np.flatnonzero(escaper)
        nxt = b[np.minimum(at + 1, size - 1)]
        bad = ~((nxt == 47) | (nxt == 34) | (nxt == 92)) | (at + 1 >= off[row[at] + 1])
        irregular[row[at[bad]]] = True
    escaped = np.zeros(size, bool)
    escaped[1:] = escaper[:-1]

    # quote parity: double quotes first, then single quotes outside of them
    base = off[:-1]

    def parity(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.cumsum(q)
        before = np.where(base > 0, c[np.maximum(base - 1, 0)], 0)
        odd = (c - before[row]) % 2 == 1  # at an opening quote and inside
        total = np.where(lens > 0, c[np.maximum(off[1:] - 1, 0)] - before, 0)
        return odd, total

    prev, nxt = np.empty(size, np.uint8), np.empty(size, np.uint8)
    prev[1:], nxt[:-1] = b[:-1], b[1:]
    prev[0] = nxt[-1] = 32
    nonempty = lens > 0
    prev[base[nonempty]] = 32
    nxt[off[1:][nonempty] - 1] = 32
    inside = np.zeros(size, bool)
    opens, shuts, doubled = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
    for quote in (34, 39):
        q = (b == quote) & ~escaped & ~inside
        if not q.any():
            continue
        odd, total = parity(q)
        irregular |= total % 2 == 1
        o, s = q & odd, q & ~odd
        pair = np.zeros(size, bool)  # the second quote of a doubled one: an opening right after a closing
        pair[1:] = o[1:] & s[:-1] & (row[1:] == row[:-1])
        shut_of_pair = np.zeros(size, bool)
        shut_of_pair[:-1] = pair[1:]
        first_of_pair_inside = shut_of_pair
        o2, s2 = o & ~pair, s & ~first_of_pair_inside
        irregular[row[np.flatnonzero(o2 & ~_CUT[prev])]] = True
        irregular[row[np.flatnonzero(s2 & ~_CUT[nxt])]] = True
        opens |= o2
        shuts |= s2
        doubled |= pair
        if quote == 39:  # a double quote inside single ones
            irregular[row[np.flatnonzero((b == 34) & odd)]] = True
        inside |= odd | s
    if back.any():  # an escape in a bare value
        irregular[row[np.flatnonzero(back & ~inside)]] = True
    irregular &= valid

    # starts and ends
    cut = _CUT[b] & ~inside
    ok_row = valid & ~irregular
    bare_start = ~inside & ~cut & ok_row[row]
    bare_start &= (_CUT[prev]) | (prev == 34) | (prev == 39)
    bare_start &= (b == 47) | (b == 104)
    at = np.flatnonzero(bare_start)
    at = at[(b[at] == 47) | _starts_with(b, at, b"http://") | _starts_with(b, at, b"https://")]
    q_at = np.flatnonzero(opens & ok_row[row])
    q_end = np.flatnonzero(shuts & ok_row[row])
    # bounds of bare values: the next start of any kind, the first white space, the end of the row
    marks = np.sort(np.concatenate([at, q_at]))
    is_space = np.flatnonzero(_SPACE[b] & ~inside)
    bound = off[row[at] + 1]
    if len(marks):
        k = np.searchsorted(marks, at, "right")
        bound = np.minimum(bound, np.where(k < len(marks), marks[np.minimum(k, len(marks) - 1)], size))
    if len(is_space):
        k = np.searchsorted(is_space, at, "right")
        bound = np.minimum(bound, np.where(k < len(is_space), is_space[np.minimum(k, len(is_space) - 1)], size))
    full = np.maximum.accumulate(np.where(cut, -1, idx))  # the last byte up to here that is no separator
    end = full[bound - 1] + 1
    # a bare value that begins within another (no separator run with a link after it can): drop overlaps
    start = np.concatenate([at, q_at + 1])
    stop = np.concatenate([end, q_end])
    # white space at either end of a quoted value
    ns = np.maximum.accumulate(np.where(_SPACE[b], -1, idx))
    nf = np.minimum.accumulate(np.where(_SPACE[b], size, idx)[::-1])[::-1]
    quoted = np.concatenate([np.zeros(len(at), bool), np.ones(len(q_at), bool)])
    start = np.where(quoted & (start < size), nf[np.minimum(start, size - 1)], start)
    stop = np.where(quoted, ns[np.maximum(stop - 1, 0)] + 1, stop)
    keep = stop > start
    start, stop = start[keep], stop[keep]
    linkish = start.copy()
    esc = escaper[linkish]  # "\/path" begins with its escape
    linkish = linkish + esc
    good = (b[np.minimum(linkish, size - 1)] == 47)
    plain = b[start] == 104
    good |= plain & _http(b, escaper, start, stop)
    start, stop = start[good], stop[good]
    order = np.argsort(start, kind="stable")
    start, stop = start[order], stop[order]
    parents = row[start]

    # values without the escapes that the quoting needs
    kept = ~(escaper | doubled)
    kept_before = np.concatenate([[0], np.cumsum(kept)])
    length = kept_before[stop] - kept_before[start]
    delta = np.zeros(size + 1, np.int32)
    np.add.at(delta, start, 1)
    np.add.at(delta, stop, -1)
    body = raw[(np.cumsum(delta[:-1]) > 0) & kept]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    links = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body)))

    odd_rows = np.flatnonzero(irregular)
    if len(odd_rows):
        more = [(r, split_one(col[int(r)].as_py())) for r in odd_rows]
        extra_p = np.repeat([r for r, _ in more], [len(v) for _, v in more]).astype(np.int64)
        links = pa.concat_arrays([links, pa.array([x for _, v in more for x in v], pa.string())])
        parents = np.concatenate([parents, extra_p])
        order = np.argsort(parents, kind="stable")
        parents, links = parents[order], links.take(pa.array(order))
    return parents, links


def _http(b: np.ndarray, escaper: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether http:// or https:// is at start, its slashes escaped or not."""
    s = start + 4
    head = _starts_with(b, start, b"http") & (s < stop)
    s = s + (b[np.minimum(s, len(b) - 1)] == 115)
    for c in (58, 47, 47):
        s = s + escaper[np.minimum(s, len(b) - 1)]
        head &= (s < stop) & (b[np.minimum(s, len(b) - 1)] == c)
        s = s + 1
    return head


def _positions(parents: np.ndarray) -> np.ndarray:
    if len(parents) == 0:
        return np.zeros(0, np.int32)
    new = np.concatenate([[True], parents[1:] != parents[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(parents)), 0))
    return (np.arange(len(parents)) - first + 1).astype(np.int32)


def unpack_links(df: DataFrame, key: str = "seq", field: str = "url") -> DataFrame:
    """One row (key, pos int, link) for each link in ``field`` of each distinct ``key``.

    Repeated rows of a key count once (the least value of the field, should they differ; a null key is a key of its
    own).  Null, empty and link-less fields give no row; repeated links are kept; other columns, whatever their names,
    are not read.  Shuffles once, the rows by key, after combining on the map side.
    """
    src = df.groupBy(F.col(key).alias("k")).agg(F.min(F.col(field).cast("string")).alias("v")).where("v is not null")
    kind = src.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                parents, links = split_batch(batch.column(1))
                if len(parents):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(parents)), pa.array(_positions(parents)), links], names=["k", "pos", "link"])

    schema = T.StructType([T.StructField("k", kind), T.StructField("pos", T.IntegerType()), T.StructField("link", T.StringType())])
    return src.mapInArrow(run, schema).select(F.col("k").alias(key), "pos", "link")
