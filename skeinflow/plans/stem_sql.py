"""The stemmer as SQL for DuckDB, written from the published algorithm: one common table expression a step.

It is what the queries that stem are held against; the engine's own stemmer is ``functions.words.stem``.
"""

from __future__ import annotations

#: Fixed values of the published algorithm, with this index's two departures (bli, logi): suffix and what replaces it.
STEP_2 = "ational ate, tional tion, enci ence, anci ance, izer ize, bli ble, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble, logi log"
STEP_3 = "icate ic, ative -, alize al, iciti ic, ical ic, ful -, ness -"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _pattern(w: str) -> str:
    """v for each vowel and c for each other sign; y is a vowel after a consonant."""
    kinds = f"translate({w}, 'aeioubcdfghjklmnpqrstvwxz0123456789+', 'vvvvvccccccccccccccccccccccccccccccc')"
    return f"list_reduce(string_split({kinds}, ''), lambda a, x: a || CASE WHEN x <> 'y' THEN x WHEN right(a, 1) = 'c' THEN 'v' ELSE 'c' END, '')"


def _m(p: str) -> str:
    return f"len(regexp_extract_all({p}, 'v+c+'))"


def _short(w: str, p: str) -> str:
    return f"(right({p}, 3) = 'cvc' AND right({w}, 1) NOT IN ('w', 'x', 'y'))"


def _cut(x: str, n: str) -> str:
    return f"left({x}, greatest(len({x}) - {n}, 0))"


def _replaced(pairs: str) -> str:
    """The longest suffix decides; it is replaced where the rest has a measure."""
    each = sorted((p.split() for p in pairs.split(", ")), key=lambda p: -len(p[0]))
    cases = " ".join(f"WHEN w LIKE '%{a}' THEN CASE WHEN {_m(_cut('p', str(len(a))))} > 0 THEN {_cut('w', str(len(a)))} || '{'' if b == '-' else b}' ELSE w END" for a, b in each)
    return f"CASE {cases} ELSE w END"


def stem_ctes(words: str, name: str = "stems") -> str:
    """CTEs, the last of which is ``name`` (word, stem), of the distinct words of ``words`` (a table with the column word)."""
    steps = [
        "CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, len(w) - 2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, len(w) - 1) ELSE w END",
        # eed, ed, ing; what is cut is marked for the step after
        f"""CASE WHEN w LIKE '%eed' THEN CASE WHEN {_m(_cut('p', '3'))} > 0 THEN left(w, len(w) - 1) ELSE w END
            WHEN w LIKE '%ed' AND contains({_cut('p', '2')}, 'v') THEN left(w, len(w) - 2) || '+'
            WHEN w LIKE '%ing' AND contains({_cut('p', '3')}, 'v') THEN left(w, len(w) - 3) || '+' ELSE w END""",
        None,
        "CASE WHEN w LIKE '%y' AND contains(left(p, len(p) - 1), 'v') THEN left(w, len(w) - 1) || 'i' ELSE w END",
        _replaced(STEP_2),
        _replaced(STEP_3),
        "CASE "
        + " ".join(
            f"WHEN w LIKE '%{a}' THEN CASE WHEN {_m(_cut('p', str(len(a))))} > 1" + (f" AND right({_cut('w', '3')}, 1) IN ('s', 't')" if a == "ion" else "") + f" THEN {_cut('w', str(len(a)))} ELSE w END"
            for a in sorted(STEP_4, key=lambda a: -len(a))
        )
        + " ELSE w END",
        f"""CASE WHEN w LIKE '%e' AND ({_m(_cut('p', '1'))} > 1 OR {_m(_cut('p', '1'))} = 1 AND NOT {_short(_cut('w', '1'), _cut('p', '1'))}) THEN left(w, len(w) - 1) ELSE w END""",
        f"CASE WHEN w LIKE '%ll' AND {_m('p')} > 1 THEN left(w, len(w) - 1) ELSE w END",
    ]
    out = [f"{name}_0 AS (SELECT DISTINCT word, word AS w, {_pattern('word')} AS p FROM {words} WHERE word IS NOT NULL)"]
    for k, step in enumerate(steps):
        if step is None:
            bare, rest = "left(w, len(w) - 1)", "left(p, len(p) - 1)"
            step = f"""CASE WHEN right(w, 1) <> '+' THEN w WHEN right({bare}, 2) IN ('at', 'bl', 'iz') THEN {bare} || 'e'
                WHEN len(w) > 2 AND substr(w, len(w) - 1, 1) = substr(w, len(w) - 2, 1) AND right({rest}, 1) = 'c' THEN CASE WHEN right({bare}, 1) IN ('l', 's', 'z') THEN {bare} ELSE left(w, len(w) - 2) END
                WHEN {_m(rest)} = 1 AND {_short(bare, rest)} THEN {bare} || 'e' ELSE {bare} END"""
        out.append(f"{name}_{k + 1} AS (SELECT word, w, {_pattern('w')} AS p FROM (SELECT word, {step} AS w FROM {name}_{k}))")
    out.append(f"{name} AS (SELECT word, CASE WHEN len(word) < 3 THEN word ELSE w END AS stem FROM {name}_{len(steps)})")
    return ",\n".join(out)
