"""Words of pages: stripping markup, tokens, positions, stop words, the stemmer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The stop words of the search, in the order of their kinds.
STOP_WORDS = """
a an the and but or nor for so yet at by in of on to up as it is be am are was were been do does did has have had can could may might must shall should will would ought about above across after against along among around before behind below beneath beside between beyond concerning considering despite during except following inside into like near next off onto outside over past regarding round since through throughout toward under underneath unlike until upon with within without according alongside also any anybody anyone anything both each either everybody everyone everything few he her hers herself him himself his i it's its itself many me mine more most my myself neither no nobody none nothing one other others our ours ourselves several she some somebody someone something theirs them themselves these they this those us we what whatever which whichever who whoever whom whomever whose you your yours yourself yourselves
""".split()
#: Parts of addresses that are not indexed.
SKIPPED = "http https com net edu org gov www xml ttl xmlj rdf".split()
#: Characters of the longest page, address and word of the described indexer.  Nothing is limited unless this
#: is given.
LIMITS = {"page": 10000, "url": 100, "word": 20}


def stripped(page: Column) -> Column:
    """The page without tags: one runs from ``<`` to the next ``>`` or the end, with no ``<`` between."""
    return F.regexp_replace(page, r"<[^<>]*(>|\z)", " ")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_set(page: Column) -> Column:
    return F.array_distinct(tokens(stripped(page)))


def trimmed_word(word: Column) -> Column:
    """Without punctuation at its ends; the first character of a word that is nothing else."""
    inner = F.regexp_replace(word, "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")
    return F.when((inner == "") & (word != ""), F.substring(word, 1, 1)).otherwise(inner)


def indexed_text(host: Column, path: Column, page: Column, most: int | None = None) -> Column:
    """What the indexer reads of a page: host, path and the body; with a limit the first ``most`` characters of the body, and
    again of all three together."""
    if most is None:
        return F.concat_ws(" ", host, path, page)
    return F.substring(F.concat_ws(" ", host, path, F.substring(page, 1, most)), 1, most)


def word_positions(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, n, positions): places of each term in the text, counted from 1, ascending."""
    each = df.select(F.col(key), F.posexplode(tokens(text)).alias("p", "term"))
    return each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list((F.col("p") + 1).cast("int"))).alias("positions"))


def is_stop_word(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def all_stop_words(words: Column) -> Column:
    return F.forall(words, lambda w: w.isin(*STOP_WORDS))


def word_weight(words: Column, keep_stop_words: bool | Column) -> Column:
    """Number of words of a query: stop words count 0.05 where they are kept, and nothing where they are not."""
    small = F.when(F.lit(keep_stop_words) if isinstance(keep_stop_words, bool) else keep_stop_words, F.lit(0.05)).otherwise(F.lit(0.0))
    return F.aggregate(words, F.lit(0.0), lambda a, w: a + F.when(w.isin(*STOP_WORDS), small).otherwise(F.lit(1.0)))


# ---------------------------------------------------------------- stemmer: suffix tables over a consonant pattern
#: Fixed values of the published algorithm, with this index's two departures (bli, logi); the longest suffix decides.
_DOUBLE = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_SIMPLE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FINAL = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
_PATTERN = {c: "v" if c in "aeiou" else "c" for c in "abcdefghijklmnopqrstuvwxz"}


def _pattern(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += ("v" if out[-1:] == "c" else "c") if ch == "y" else _PATTERN.get(ch, "c")
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _pattern(word)))


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last none of w, x, y."""
    return _pattern(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _twin(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _pattern(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return next((s for s in sorted(suffixes, key=len, reverse=True) if word.endswith(s)), None)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and "v" in _pattern(w[: -len(s)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                w = cut + "e"
            elif _twin(cut):
                w = cut if cut[-1] in "lsz" else cut[:-1]
            else:
                w = cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    if w.endswith("y") and "v" in _pattern(w[:-1]):
        w = w[:-1] + "i"
    for table in (_DOUBLE, _SIMPLE):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]):
            w = w[: -len(s)] + table[s]
    s = _longest(w, _FINAL)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in words:
        yield part.map(lambda w: None if w is None else stem(w))


_stems.__annotations__ = {"words": Iterator[pd.Series], "return": Iterator[pd.Series]}


def stems_of(word: Column) -> Column:
    """Stems by a vectorised Python function; use ``with_stems`` where words repeat."""
    return F.pandas_udf(_stems, T.StringType())(word)


def _list_stems(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in lists:
        yield part.map(lambda ws: None if ws is None else [stem(w) for w in ws])


_list_stems.__annotations__ = {"lists": Iterator[pd.Series], "return": Iterator[pd.Series]}


def stem_lists(words: Column) -> Column:
    """The stems of an array of words, in order."""
    return F.pandas_udf(_list_stems, T.ArrayType(T.StringType()))(words)


def with_stems(df: DataFrame, word: str = "term", name: str = "stem") -> DataFrame:
    """Adds the stem of each word: Python sees each distinct word once, and the stems are joined back."""
    stems = df.select(F.col(word).alias("_w")).where("_w is not null").distinct().select("_w", stems_of(F.col("_w")).alias(name))
    return df.join(stems, F.col(word) == F.col("_w"), "left").drop("_w")
