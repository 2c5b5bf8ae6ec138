"""Markup residue: structure and clean text of pages in HTML, Markdown, wiki text and LaTeX.

The format is told from the text, as content types are often missing or wrong.  Elements are headings, list items, code
blocks and formulas, in the order in which they start.  Tag-path ratios select the content nodes of HTML pages: each element
is marked by the node it stands in, as content or as part of a site frame, and the clean text has the content nodes only.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADING, ITEM, CODE, FORMULA = "heading", "list_item", "code", "formula"
#: A paragraph, its markup left in; for the clean text only.
TEXT = "text"
Element = tuple[int, str, str]  # start, kind, content


def squeeze(s: str) -> str:
    """Runs of white space, no-break spaces included, as one space; none at the ends."""
    return " ".join(s.split())


def code_lines(s: str) -> str:
    """Code without trailing white space of lines, blank first and last lines."""
    lines = [x.rstrip() for x in s.split("\n")]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


# ---------------------------------------------------------------- format

_HTML_SURE = re.compile(r"<(?:!doctype\s+html|html|head|body)\b", re.I)
_HTML_BLOCK = re.compile(r"</?(?:p|div|h[1-6]|ul|ol|li|table|tr|td|br|hr|section|article|nav|header|footer|main|aside|blockquote|font|span|dl)\b[^<>\n]*>", re.I)
_TEX = re.compile(r"^[ \t]*\\(?:documentclass|usepackage|chapter|part|(?:sub){0,2}section|maketitle|begin|end|item|title)\b", re.M)
_WIKI = re.compile(r"^={2,6}[^=\n].*=[ \t]*\r?$|\[\[[^\[\]\n]+\]\]|'''|''|^\{\||^\{\{|<ref\b|<math\b|<syntaxhighlight\b|\[https?://[^\s\]]+ [^\]\n]+\](?!\()|\{\{cite", re.M)
_MD = re.compile(r"(?:\A|(?<=\n)[ \t]*\n) {0,3}#{1,6} \S.*\n?[ \t]*(?=\n|\Z)|^ {0,3}(?:```+|~~~+)|\]\([^()\s]*\)|\*\*\S|__\S|`[^`\n]+`|^>[ ]|^[^\s<|].*\n(?:=+|-+)[ \t]*\r?$|^\|[-: |]+\|[ \t]*\r?$|^\d{1,3}[.)] |^[-+] \S", re.M)


def page_format(page: str) -> str:
    """html, latex, wiki, markdown or text."""
    if _HTML_SURE.search(page):
        return "html"
    tex = len(_TEX.findall(page))
    wiki = len(_WIKI.findall(page))
    md = len(_MD.findall(page))
    blocks = len(_HTML_BLOCK.findall(page))
    if blocks > 1 and blocks > max(tex, wiki, md):
        return "html"
    best = max(tex, wiki, md)
    if best == 0:
        return "text"
    if tex == best:
        return "latex"
    return "wiki" if wiki == best else "markdown"


# ---------------------------------------------------------------- HTML

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|noscript|template|textarea)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_STRUCTURE = re.compile(r"<(/?)(h[1-6]|li|[uo]l|pre)(?=[\s>/])[^<>]*>", re.I)
_BREAKING = re.compile(r"</?(?:br|p|div|li|[uo]l|h[1-6]|t[rdh]|table|hr|blockquote|dt|dd|dl|section|article|main|aside|nav|header|footer|pre)\b[^<>]*>", re.I)
_ANY_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
_PRE_END = re.compile(r"</pre\s*>", re.I)
#: An opening sign is looked for once: what it opens holds no other of its kind.
_DISPLAYED = re.compile(r"\\\(((?:(?!\\\().)+?)\\\)|\\\[((?:(?!\\\[).)+?)\\\]|\$\$(.+?)\$\$", re.S)
_CODE_SPAN = re.compile(r"<(pre|code)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)


def html_text(s: str) -> str:
    if "<" in s:
        s = _ANY_TAG.sub("", _BREAKING.sub(" ", s))
    if "&" in s:
        s = unescape(s)
    return " ".join(s.split())


def html_elements(s: str) -> list[Element]:
    """Elements of an HTML page without what it hides."""
    out: list[Element] = []
    levels: list[list | None] = [None]  # the open item of each open list
    heading: list | None = None  # [start, texts]
    texts: list[tuple[str, list]] = []
    at = 0

    def close(item: list, kind: str) -> None:
        texts.append((kind, item))

    pos = 0
    while True:
        m = _STRUCTURE.search(s, pos)
        chunk = s[at : m.start()] if m else s[at:]
        if chunk:
            if heading is not None:
                heading[1].append(chunk)
            else:
                for item in reversed(levels):
                    if item is not None:
                        item[1].append(chunk)
                        break
        if not m:
            break
        shut, tag = m.group(1), m.group(2).lower()
        pos = at = m.end()
        if tag == "li":
            if levels[-1] is not None:
                close(levels[-1], ITEM)
                levels[-1] = None
            if not shut:
                levels[-1] = [m.start(), []]
        elif tag in ("ul", "ol"):
            if not shut:
                levels.append(None)
            else:
                if levels[-1] is not None:
                    close(levels[-1], ITEM)
                    levels[-1] = None
                if len(levels) > 1:
                    levels.pop()
        elif tag == "pre":
            if not shut:
                end = _PRE_END.search(s, pos)
                body = s[pos : end.start() if end else len(s)]
                content = code_lines(unescape(_ANY_TAG.sub("", body)).replace("\xa0", " "))
                if content:
                    out.append((m.start(), CODE, content))
                pos = at = end.end() if end else len(s)
        else:
            if heading is not None:
                close(heading, HEADING)
                heading = None
            if not shut:
                heading = [m.start(), []]
    if heading is not None:
        close(heading, HEADING)
    for item in levels:
        if item is not None:
            close(item, ITEM)
    for kind, (start, parts) in texts:
        content = html_text(" ".join(parts) if len(parts) > 1 else "".join(parts))
        if content:
            out.append((start, kind, content))
    if "\\(" in s or "\\[" in s or "$$" in s:
        blank = _CODE_SPAN.sub(lambda m: " " * len(m.group()), s)
        for m in _DISPLAYED.finditer(blank):
            content = html_text(m.group(1) or m.group(2) or m.group(3))
            if content:
                out.append((m.start(), FORMULA, content))
    out.sort(key=lambda e: e[0])
    return out


# ---------------------------------------------------------------- Markdown

_FENCE = re.compile(r"^( *)(`{3,}|~{3,})([^`]*)$")
_ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^([ \t]*)([-*+]|\d{1,9}[.)])(?:[ \t]+(.*))?$")
_MD_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_MD_CODE = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_MD_LINK = re.compile(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\](?:\((?:[^()\s]|\([^()]*\))*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)|\[[^\[\]]*\])")
_AUTOLINK = re.compile(r"<((?:https?|mailto|ftp):[^<>\s]+)>")
_SIGNS = re.compile(r"\*+|_+")
_STRIKE = re.compile(r"~~(?=\S)(.+?)(?<=\S)~~", re.S)
#: Inline dollars: no space inside at either end, no digit after the closing one, so amounts of money are none.
_MD_FORMULA = re.compile(r"\$\$(.+?)\$\$|(?<![\\$\w])\$(?![\s$])((?:\\.|[^$\\\n]|\n(?!\s*\n))*?)(?<![\s\\])\$(?![\d$])|\\\(((?:(?!\\\().)+?)\\\)|\\\[((?:(?!\\\[).)+?)\\\]", re.S)
_BLOCK_START = re.compile(r"^ {0,3}(?:#{1,6}(?:[ \t]|$)|>|```|~~~)|^\|")


def without_emphasis(s: str) -> str:
    """Without the stars and underscores that mark emphasis, at any depth: a run that can close takes signs from the nearest
    run of its kind that can open."""

    def mark(c: str) -> bool:
        return not c.isalnum() and not "\ue000" <= c <= "\ue001"

    runs: list[list] = []  # start, length, signs left, taken from the left, taken from the right
    opened: list[tuple[int, bool]] = []  # number of the run, whether it can close too
    bottom: dict[tuple[str, bool, int], int] = {}
    for m in _SIGNS.finditer(s):
        sign, size = m.group()[0], len(m.group())
        before, after = s[m.start() - 1 : m.start()] or " ", s[m.end() : m.end() + 1] or " "
        left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
        right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
        opens, closes = (left, right) if sign == "*" else (left and (not right or mark(before)), right and (not left or mark(after)))
        number = len(runs)
        runs.append([m.start(), size, size, 0, 0])
        if closes:
            kind = (sign, opens, size % 3)
            at = len(opened) - 1
            while at >= 0 and runs[number][2] and opened[at][0] >= bottom.get(kind, 0):
                k, both = opened[at]
                if s[runs[k][0]] == sign and not ((both or opens) and (runs[k][1] + size) % 3 == 0 and (runs[k][1] % 3 or size % 3)):
                    use = min(runs[k][2], runs[number][2])
                    runs[k][2] -= use
                    runs[k][4] += use
                    runs[number][2] -= use
                    runs[number][3] += use
                    del opened[at + (runs[k][2] > 0) :]
                at -= 1
            if runs[number][2] == size:
                bottom[kind] = opened[-1][0] + 1 if opened else 0
        if opens and runs[number][2]:
            opened.append((number, closes))
    out, at = [], 0
    for start, size, _, first, last in runs:
        if first or last:
            out += [s[at:start], s[start : start + size - first - last]]
            at = start + size
    return "".join([*out, s[at:]])


def md_inline(s: str, formulas: bool = False) -> str:
    """Without markup; ``formulas`` keeps formulas as they stand."""
    kept: list[str] = []

    def keep(text: str) -> str:
        kept.append(text)
        return f"\ue000{len(kept) - 1}\ue001"

    if "`" in s:
        s = _MD_CODE.sub(lambda m: keep(m.group(2).strip()), s)
    if formulas and ("$" in s or "\\(" in s or "\\[" in s):
        s = _MD_FORMULA.sub(lambda m: keep(m.group()), s)
    if "\\" in s:
        s = _MD_ESCAPE.sub(lambda m: keep(m.group(1)), s)
    if "](" in s or "][" in s:
        s = _MD_LINK.sub(r"\1", s)
    if "<" in s:
        s = _ANY_TAG.sub("", _AUTOLINK.sub(r"\1", s))
    if "*" in s or "_" in s:
        s = without_emphasis(s)
    if "~~" in s:
        s = _STRIKE.sub(r"\1", s)
    if "&" in s:
        s = unescape(s)
    while "\ue000" in s and kept:
        t = re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m.group(1))], s)
        if t == s:
            break
        s = t
    return squeeze(s)


def _indent(line: str) -> int:
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def _md_formulas(text: str, start: int, out: list[Element]) -> None:
    if "$" not in text and "\\(" not in text and "\\[" not in text:
        return
    blank = _MD_CODE.sub(lambda m: " " * len(m.group()), text)
    for m in _MD_FORMULA.finditer(blank):
        content = squeeze(next((g for g in m.groups() if g), ""))
        if content:
            out.append((start + m.start(), FORMULA, content))


def md_elements(page: str) -> list[Element]:
    out: list[Element] = []
    todo = [(page.split("\n"), 0)]
    while todo:  # quotes within quotes, of any depth
        _md_blocks(*todo.pop(), out, todo)
    # starts are numbers of lines and places within; see _md_blocks
    out.sort(key=lambda e: e[0])
    return out


_LINE = 1 << 24  # places: number of the line times _LINE, plus the place within its block


_QUOTED = re.compile(r"(?:> ?)+")


def _md_blocks(text: list[str], first: int, out: list[Element], quotes: list[tuple[list[str], int]]) -> None:
    """Elements of a block of lines, of which ``first`` is the number of the first; blocks that it quotes go to ``quotes``."""
    n = len(text)
    i = 0
    para: list[str] = []
    para_at = 0
    item: list[str] | None = None  # texts of the open list item
    item_at = 0
    indents: list[int] = []  # content columns of open items
    after_blank = True

    def end_para(heading: bool = False) -> None:
        nonlocal para
        if para:
            if heading:
                content = md_inline("\n".join(para))
                if content:
                    out.append(((first + para_at) * _LINE, HEADING, content))
            else:
                out.append(((first + para_at) * _LINE, TEXT, "\n".join(para)))
            _md_formulas("\n".join(para), (first + para_at) * _LINE + 1, out)
            para = []

    def end_item() -> None:
        nonlocal item
        if item is not None:
            joined = "\n".join(item)
            content = md_inline(joined)
            if content:
                out.append(((first + item_at) * _LINE, ITEM, content))
            _md_formulas(joined, (first + item_at) * _LINE + 1, out)
            item = None

    while i < n:
        line = text[i]
        if not line.strip():
            end_para()
            end_item()
            after_blank = True
            i += 1
            continue
        depth = _indent(line)
        stripped = line.strip()
        # comments
        if stripped.startswith("<!--") and depth < 4:
            end_para()
            end_item()
            j = i
            while j < n and "-->" not in text[j]:
                j += 1
            rest = text[j].split("-->", 1)[1] if j < n else ""
            i = j + 1
            if rest.strip():
                text[j] = rest
                i = j
            after_blank = True
            continue
        m = _FENCE.match(line)
        if m and (depth < 4 or indents) and not (m.group(2)[0] == "`" and "`" in m.group(3)):
            end_para()
            end_item()
            if depth < 2:
                indents = []
            mark, pad = m.group(2), len(m.group(1))
            j = i + 1
            body = []
            while j < n:
                e = text[j].strip()
                if e and e[0] == mark[0] and len(e) >= len(mark) and not e.strip(mark[0]) and _indent(text[j]) < pad + 4:
                    break
                own = text[j]
                body.append(own[min(pad, len(own) - len(own.lstrip(" "))) :])
                j += 1
            content = code_lines("\n".join(body))
            if content:
                out.append(((first + i) * _LINE, CODE, content))
            i = j + 1
            after_blank = True
            continue
        im = _ITEM.match(line)
        is_item = bool(im) and not _RULE.match(line) and (depth < 4 or (indents and depth < indents[-1] + 4))
        if is_item and para and im and im.group(2)[0].isdigit() and im.group(2)[:-1] != "1":
            is_item = False
        if is_item and im and not (im.group(3) or "").strip():
            is_item = not para
        if is_item and im:
            end_para()
            end_item()
            while indents and depth < indents[-1]:
                indents.pop()
            width = depth + len(im.group(2)) + 1
            indents.append(width)
            item, item_at = [im.group(3) or ""], i
            after_blank = False
            i += 1
            continue
        if item is not None and not _BLOCK_START.match(line) and not _RULE.match(line):
            item.append(stripped)  # continuation, lazy or indented
            i += 1
            continue
        if depth < 2:
            indents = []
        if depth >= 4 and not para and after_blank and not (indents and depth < indents[-1] + 4 and depth >= indents[-1]):
            j = i
            body = []
            while j < n and (not text[j].strip() or _indent(text[j]) >= 4):
                body.append(text[j].replace("\t", "    ", 1)[4:] if text[j].strip() else "")
                j += 1
            content = code_lines("\n".join(body))
            if content:
                out.append(((first + i) * _LINE, CODE, content))
            i = j
            continue
        end_item()
        if stripped.startswith(">") and depth < 4:
            end_para()
            j = i
            inner = []
            while j < n and text[j].strip() and (text[j].lstrip().startswith(">") or (inner and inner[-1].strip() and not _BLOCK_START.match(text[j]) and not _ITEM.match(text[j]))):
                q = text[j].lstrip()
                inner.append(q[2:] if q.startswith("> ") else q[1:] if q.startswith(">") else q)
                j += 1
            marks = [m.group() if (m := _QUOTED.match(q)) else "" for q in inner]
            deep = min(m.count(">") for m in marks) - 1  # all but one of the quotes that all lines are in
            if deep > 0:
                inner = [q[re.match("(?:> ?){%d}" % deep, q).end() :] for q in inner]
            quotes.append((inner, first + i))
            i = j
            after_blank = True
            continue
        a = _ATX.match(line)
        if a:
            end_para()
            content = md_inline(a.group(1) or "")
            if content:
                out.append(((first + i) * _LINE, HEADING, content))
            i += 1
            after_blank = True
            continue
        if para and _SETEXT.match(line) and not (len(para) and para[0].startswith("|")):
            end_para(heading=True)
            i += 1
            after_blank = True
            continue
        if _RULE.match(line):
            end_para()
            i += 1
            after_blank = True
            continue
        if stripped == "$$":
            end_para()
            j = i + 1
            while j < n and text[j].strip() != "$$":
                j += 1
            if j < n:
                content = squeeze(" ".join(text[i + 1 : j]))
                if content:
                    out.append(((first + i) * _LINE, FORMULA, content))
                    out.append(((first + i) * _LINE, TEXT, f"$${content}$$"))
                i = j + 1
                after_blank = True
                continue
        if stripped.startswith("|") and stripped.endswith("|") and len(stripped) > 1:
            end_para()  # a row of a table
            i += 1
            after_blank = False
            continue
        if not para:
            para_at = i
        para.append(line)
        after_blank = False
        i += 1
    end_para()
    end_item()


# ---------------------------------------------------------------- wiki text

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_WIKI_CODE = re.compile(r"<(pre|syntaxhighlight|source)\b[^<>]*>(.*?)(?:</\1\s*>|\Z)", re.I | re.S)
_WIKI_MATH = re.compile(r"<math\b[^<>]*(?<!/)>((?:(?!<math\b).)*?)</math\s*>", re.I | re.S)
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?(?:</ref\s*>|\Z)", re.I | re.S)
_TEMPLATE = re.compile(r"\{\{(?:[^{}]|\{[^{}]*\})*\}\}")
_WIKI_TABLE = re.compile(r"^[ \t:]*\{\|.*?(?:^[ \t]*\|\}|\Z)", re.M | re.S)
_WIKI_LINE = re.compile(r"^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$|^([*#:;]*[*#])[ \t]*(.*)$|^([*#:;]+)(.*)$", re.M)
_WIKI_FILE = re.compile(r"\[\[(?:Category|File|Image|Kategorie|Datei|Categoría|Archivo|Catégorie|Fichier)\s*:[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]", re.I)
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_WIKI_URL = re.compile(r"\[(?:https?:|ftp:|mailto:)?//[^\s\]]+(?:\s+([^\]]*))?\]")
_QUOTES = re.compile(r"'{5}|'{2,3}")


def wiki_inline(s: str) -> str:
    if "[[" in s:
        s = _WIKI_FILE.sub("", s)
        s = _WIKI_LINK.sub(r"\1", s)
    if "[" in s:
        s = _WIKI_URL.sub(lambda m: m.group(1) or "", s)
    if "''" in s:
        s = _QUOTES.sub("", s)
    if "<" in s:
        s = _ANY_TAG.sub("", _BREAKING.sub(" ", s))
    if "&" in s:
        s = unescape(s)
    return squeeze(s)


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def _dollars(m: re.Match) -> str:
    """A formula in dollars, as long as what it stands for."""
    return f"${m.group(1)}$".ljust(len(m.group()))


def wiki_elements(page: str) -> list[Element]:
    out: list[Element] = []

    def code(m: re.Match) -> str:
        content = code_lines(unescape(m.group(2)))
        if content:
            out.append((m.start(), CODE, content))
        return _blank(m)

    # code first keeps comments in it; places stay as all blanks have the length of what they hide
    if "<!--" in page:
        spans = [m.span() for m in _WIKI_CODE.finditer(page)]
        page = _COMMENT.sub(lambda m: m.group() if any(a < m.start() < b for a, b in spans) else _blank(m), page)
    s = _WIKI_CODE.sub(code, page)
    s = _REF.sub(_blank, s) if "<ref" in s.lower() else s
    s = _WIKI_TABLE.sub(_blank, s) if "{|" in s else s
    while "{{" in s:
        t = _TEMPLATE.sub(_blank, s)
        if t == s:
            break
        s = t
    maths: list[tuple[int, str]] = []

    def formula(m: re.Match) -> str:
        content = squeeze(unescape(m.group(1)))
        if content:
            maths.append((m.start(), content))
            out.append((m.start(), FORMULA, content))
        return m.group()

    _WIKI_MATH.sub(formula, s)
    for m in _WIKI_LINE.finditer(s):
        if m.group(1):
            content = wiki_inline(m.group(2))
            if content:
                out.append((m.start(), HEADING, content))
        elif m.group(3):
            content = wiki_inline(m.group(4))
            if content:
                out.append((m.start(), ITEM, content))
    place = 0
    for line in _WIKI_MATH.sub(_dollars, s).split("\n"):
        if line.strip() and line[0] not in " *#:;=":
            out.append((place, TEXT, line))
        place += len(line) + 1
    # lines that begin with a space are preformatted
    run: list[str] = []
    run_at, place = 0, 0
    original = page.split("\n")
    for line, own in zip(s.split("\n") + [""], original + [""], strict=True):
        if line.startswith(" ") and line.strip() and not line.lstrip().startswith(("{|", "|", "!")):
            if not run:
                run_at = place
            run.append(own[1:])
        else:
            if run:
                content = code_lines(unescape(_ANY_TAG.sub("", "\n".join(run))))
                if content:
                    out.append((run_at, CODE, content))
            run = []
        place += len(line) + 1
    out.sort(key=lambda e: e[0])
    return out


# ---------------------------------------------------------------- LaTeX

_TEX_CODE = re.compile(r"\\begin\{(verbatim\*?|Verbatim|lstlisting|minted|alltt)\}((?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?)(.*?)(?:\\end\{\1\}|\Z)", re.S)
_TEX_COMMENT = re.compile(r"(?<!\\)((?:\\\\)*)%[^\n]*")
_TEX_VERB = re.compile(r"\\(?:verb\*?|lstinline)([^\w\s*{])(.*?)\1")
_MATH_ENV = "equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat"
_TEX_FORMULA = re.compile(
    rf"\\begin\{{({_MATH_ENV})(\*?)\}}((?:(?!\\begin\{{\1\2\}}).)*?)\\end\{{\1\2\}}|(?<!\\)\\\[((?:(?!(?<!\\)\\\[).)+?)(?<!\\)\\\]|(?<!\\)\\\(((?:(?!(?<!\\)\\\().)+?)(?<!\\)\\\)|(?<!\\)\$\$(.+?)(?<!\\)\$\$|(?<![\\$])\$(?!\$)((?:\\.|[^$\\])+?)\$",
    re.S,
)
_TEX_SECTION = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]\n]*\])?\{")
_TEX_LIST = re.compile(r"\\(begin|end)\{(itemize|enumerate|description|compactitem|compactenum)\}(?:\[[^\]\n]*\])?|\\item\b(?:[ \t]*\[[^\]\n]*\])?|\\(?:part|chapter|(?:sub){0,2}section)\*?\{|\\(?:begin|end)\{document\}")
_TEX_DROP = re.compile(r"~?\\(?:cite[a-z]*|label|ref|eqref|pageref|footnote|index|vspace|hspace|includegraphics)\*?(?:\[[^\]]*\])*\{(?:[^{}]|\{[^{}]*\})*\}")
_TEX_HREF = re.compile(r"\\href\{[^{}]*\}\{((?:[^{}]|\{[^{}]*\})*)\}")
_TEX_ARG = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}")
_TEX_SWITCH = re.compile(r"\\(?:it|bf|tt|em|sc|sf|rm|sl|small|large|Large|footnotesize|itshape|bfseries|ttfamily|centering|noindent|par|item|maketitle)\b[ \t]*")
_TEX_SYMBOL = re.compile(r"\\([&%$#_{} ])")
#: LaTeX commands that stand for one character.
_TEX_CHARS = {"textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^", "ldots": "…", "dots": "…", "LaTeX": "LaTeX", "TeX": "TeX", "S": "§", "ss": "ß"}
_TEX_NAMED = re.compile(r"\\(textbackslash|textasciitilde|textasciicircum|ldots|dots|LaTeX|TeX|ss|S)\b(?:\{\})?[ \t]?")


_BRACE = re.compile(r"\\.|[{}]", re.S)


def _headings(s: str) -> list[tuple[int, int, int]]:
    """(start, place after the opening brace, place of the closing one) of each heading that is in no other.

    All braces are matched in one pass; a heading whose brace is never closed ends with its line.
    """
    found = list(_TEX_SECTION.finditer(s))
    if not found:
        return []
    closing: dict[int, int] = {}
    stack: list[int] = []
    for m in _BRACE.finditer(s):
        if m.group() == "{":
            stack.append(m.start())
        elif m.group() == "}" and stack:
            closing[stack.pop()] = m.start()
    out = []
    last = 0
    for m in found:
        if m.start() < last:
            continue
        line = s.find("\n", m.end())
        end = closing.get(m.end() - 1, len(s) if line < 0 else line)
        out.append((m.start(), m.end(), end))
        last = end
    return out


def tex_inline(s: str, formula: str = "{}") -> str:
    """Without markup; a formula as ``formula`` has it."""
    kept: list[str] = []

    def keep(text: str) -> str:
        kept.append(text)
        return f"\ue000{len(kept) - 1}\ue001"

    s = _TEX_VERB.sub(lambda m: keep(m.group(2)), s)
    s = _TEX_FORMULA.sub(lambda m: keep(formula.format(squeeze(next((g for g in m.groups()[2:] if g), "")))), s)
    s = s.replace("\\\\", " ")
    s = _TEX_SYMBOL.sub(lambda m: keep(m.group(1)), s)
    s = _TEX_DROP.sub("", s)
    while True:
        t = _TEX_ARG.sub(r"\1", _TEX_HREF.sub(r"\1", s))
        if t == s:
            break
        s = t
    s = _TEX_NAMED.sub(lambda m: keep(_TEX_CHARS[m.group(1)]), s)
    s = _TEX_SWITCH.sub("", s)
    s = re.sub(r"\\[A-Za-z]+\*?", "", s)
    s = s.replace("{", "").replace("}", "").replace("~", " ")
    s = re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m.group(1))], s)
    return squeeze(s)


def tex_elements(page: str) -> list[Element]:
    out: list[Element] = []

    def code(m: re.Match) -> str:
        head, body = m.group(2), m.group(3)
        if m.group(1) in ("verbatim", "verbatim*", "alltt"):
            body = head + body
        content = code_lines(body)
        if content:
            out.append((m.start(), CODE, content))
        return _blank(m)

    begin = page.find("\\begin{document}")
    stop = page.find("\\end{document}")
    s = page
    # comments go, but not in code: code is found where its line isn't a comment
    pieces, at = [], 0
    for m in _TEX_CODE.finditer(s):
        line = s[s.rfind("\n", 0, m.start()) + 1 : m.start()]
        if re.search(r"(?<!\\)(?:\\\\)*%", line) or m.start() < at:
            continue
        pieces.append(_TEX_COMMENT.sub(lambda c: c.group(1) + " " * (len(c.group()) - len(c.group(1))), s[at : m.start()]))
        pieces.append(m.group())
        at = m.end()
    pieces.append(_TEX_COMMENT.sub(lambda c: c.group(1) + " " * (len(c.group()) - len(c.group(1))), s[at:]))
    s = "".join(pieces)
    if begin >= 0:
        s = re.sub(r"[^\n]", " ", s[: begin + 16]) + s[begin + 16 :]
    if stop >= 0:
        s = s[:stop]
    s = _TEX_CODE.sub(code, s)
    plain = _TEX_VERB.sub(_blank, s)
    for m in _TEX_FORMULA.finditer(plain):
        content = squeeze(next((g for g in m.groups()[2:] if g), ""))
        if content:
            out.append((m.start(), FORMULA, content))
    headings = _headings(s)
    for start, inner, end in headings:
        content = tex_inline(s[inner:end])
        if content:
            out.append((start, HEADING, content))
    hidden = list(s)  # what is left of it are paragraphs

    def hide(a: int, b: int) -> None:
        for i in range(a, min(b, len(hidden))):
            if hidden[i] != "\n":
                hidden[i] = " "

    depth = opened = 0
    for m in _TEX_LIST.finditer(s):
        if m.group(1) == "begin":
            opened = m.start() if depth == 0 else opened
            depth += 1
        elif m.group(1) == "end" and depth:
            depth -= 1
            if depth == 0:
                hide(opened, m.end())
    if depth:
        hide(opened, len(s))
    for start, _, end in headings:
        hide(start, end + 1)
    for m in re.finditer(r"\S(?:.|\n(?![ \t]*\n))*", "".join(hidden)):
        out.append((m.start(), TEXT, m.group()))
    stack: list[list] = []  # of open lists: [is a description list, start of the item or None, texts]
    last = 0

    def done(level: list) -> None:
        if level[1] is not None and not level[0]:
            content = tex_inline(" ".join(level[2]))
            if content:
                out.append((level[1], ITEM, content))
        level[1], level[2] = None, []

    for m in _TEX_LIST.finditer(s):
        if stack and stack[-1][1] is not None:
            stack[-1][2].append(s[last : m.start()])
        last = m.end()
        if m.group(1) == "begin":
            stack.append([m.group(2) == "description", None, []])
        elif m.group(1) == "end":
            if stack:
                done(stack.pop())
        elif m.group().startswith("\\item"):
            if not stack:
                stack.append([False, None, []])
            done(stack[-1])
            stack[-1][1] = m.start()
        else:
            while stack:
                done(stack.pop())
    while stack:
        level = stack.pop()
        if level[1] is not None:
            level[2].append(s[last:])
            last = len(s)
        done(level)
    out.sort(key=lambda e: e[0])
    return out


_PARSERS = {"html": html_elements, "latex": tex_elements, "wiki": wiki_elements, "markdown": md_elements}


def elements(page: str | None) -> list[tuple[str, str]]:
    """(kind, content) of the elements of a page, in the order in which they start; none of a null or blank page."""
    return [(kind, content) for kind, content, _ in marked_elements(page)]


def marked_elements(page: str | None) -> list[tuple[str, str, bool]]:
    """(kind, content, whether it is content) of the elements of a page: by the tag-path ratios of an HTML page, and always
    in other markup, which has no frames of tags."""
    if not page or page.isspace():
        return []
    page = page.replace("\r\n", "\n").replace("\r", "\n")
    kind_of_page = page_format(page)
    parser = _PARSERS.get(kind_of_page)
    if parser is None:
        return []
    if kind_of_page != "html":
        return [(kind, content, True) for _, kind, content in parser(page) if kind != TEXT]
    page = _HIDDEN.sub("", page)
    found = parser(page)
    if not found:
        return []
    nodes = path_nodes(page)
    keep = content_nodes(nodes)
    starts = [n[0] for n in nodes]
    out = []
    for start, kind, content in found:
        # a formula stands within its node, the tag of another element before its first
        at = bisect_right(starts, start) - 1 if kind == FORMULA else bisect_left(starts, start)
        out.append((kind, content, keep[min(max(at, 0), len(keep) - 1)] if keep else False))
    return out


# ---------------------------------------------------------------- tag-path ratios

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^<>]*>")
#: Elements without an end tag, and inline elements that are no part of a path.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data em font i kbd mark q s samp small span strong sub sup time u var".split())
_HEADING_TAG = re.compile("h[1-6]")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？]")


Node = tuple[int, str, str, int]  # start of its text, path, text, characters of it in links


def path_nodes(s: str) -> list[Node]:
    """The text nodes of an HTML page without what it hides, in their order; the text of ``pre`` keeps its lines."""
    stack: list[str] = []
    nodes: list[Node] = []
    parts: list[str] = []
    linked, in_link, at, began = 0, False, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = unescape("".join(parts))
            text = code_lines(text.replace("\xa0", " ")) if "pre" in stack else squeeze(text)
            if text:
                nodes.append((began, "/".join(stack), text, linked))
            parts.clear()
            linked = 0

    def add(chunk: str, start: int) -> None:
        nonlocal linked, began
        if parts or not chunk.isspace():
            if not parts:
                began = start + len(chunk) - len(chunk.lstrip())
            parts.append(chunk)
            if in_link:
                linked += len(chunk)

    for m in _TAG.finditer(s):
        if m.start() > at:
            add(s[at : m.start()], at)
        at = m.end()
        shut, tag = m.group(1), m.group(2).lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = not shut
            continue
        if tag == "br" and "pre" in stack:
            parts.append("\n")
            continue
        flush()
        if tag in _VOID:
            continue
        if not shut:
            if tag in ("p", "li", "td", "tr", "dt", "dd") and stack and stack[-1] == tag:
                stack.pop()  # its end tag was left out
            stack.append(tag)
        elif tag in stack:
            while stack.pop() != tag:
                pass
    if at < len(s):
        add(s[at:], at)
    flush()
    return nodes


def content_nodes(nodes: list[Node], width: int = 2) -> list[bool]:
    """Which nodes are content: tag-path text ratio fused with the punctuation ratio of the path, smoothed over
    neighbouring nodes, against a threshold (the mean less half a deviation, of the page).

    Code and headings have few words and little punctuation: code is content where a node beside it is or the threshold
    says so, a heading where the next node that is none is content.
    """
    if not nodes:
        return []
    length: dict[str, int] = {}
    marks: dict[str, int] = {}
    count: dict[str, int] = {}
    for _, path, text, linked in nodes:
        length[path] = length.get(path, 0) + max(0, len(text) - linked)
        marks[path] = marks.get(path, 0) + len(_PUNCTUATION.findall(text))
        count[path] = count.get(path, 0) + 1
    fused = [math.sqrt((length[p] / count[p]) * (1 + marks[p] / count[p])) for _, p, _, _ in nodes]
    smooth = [sum(fused[max(0, i - width) : i + width + 1]) / len(fused[max(0, i - width) : i + width + 1]) for i in range(len(fused))]
    mean = sum(smooth) / len(smooth)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    # a node of links is none, whatever is beside it
    keep = [x >= mean - deviation / 2 and linked <= 0.6 * len(text) for x, (_, _, text, linked) in zip(smooth, nodes, strict=True)]
    last = [path.rsplit("/", 1)[-1] for _, path, _, _ in nodes]
    for i, (_, path, _, _) in enumerate(nodes):
        if "pre" in path.split("/") and not keep[i]:
            keep[i] = any(keep[max(0, i - 1) : i + 2])
    following = False
    for i in range(len(nodes) - 1, -1, -1):
        if _HEADING_TAG.fullmatch(last[i]):
            keep[i] = keep[i] or following
        else:
            following = keep[i]
    return keep


def main_text(page: str | None) -> str | None:
    """Clean text, in the page's order: headings as '# ' (in HTML one sign for each level), items as '- ', code in fences,
    formulas in dollars; of HTML the content nodes, one a line, of other markup the whole page.  Null for a null page."""
    if page is None:
        return None
    page = page.replace("\r\n", "\n").replace("\r", "\n")
    kind = page_format(page)
    if kind == "html":
        nodes = path_nodes(_HIDDEN.sub("", page))
        return "\n".join(_rendered(path, text) for (_, path, text, _), keep in zip(nodes, content_nodes(nodes), strict=True) if keep)
    if kind == "text":
        return "\n".join(squeeze(x) for x in page.split("\n")).strip()
    inline = {"markdown": lambda x: md_inline(x, formulas=True), "wiki": wiki_inline, "latex": lambda x: tex_inline(x, "${}$")}[kind]
    marks = {HEADING: "# {}", ITEM: "- {}", CODE: "```\n{}\n```"}
    # formulas stand in their paragraphs
    lines = [inline(c) if k == TEXT else marks[k].format(c) for _, k, c in _PARSERS[kind](page) if k != FORMULA]
    return "\n".join(x for x in lines if x)


def _rendered(path: str, text: str) -> str:
    tags = path.split("/")
    if "pre" in tags:
        return f"```\n{text}\n```"
    text = _DISPLAYED.sub(lambda m: f"${squeeze(m.group(1))}$" if m.group(1) else f"$${squeeze(m.group(2) or m.group(3))}$$", text)
    if _HEADING_TAG.fullmatch(tags[-1]):
        return "#" * int(tags[-1][1]) + " " + text
    return "- " + text if tags[-1] == "li" else text


# ---------------------------------------------------------------- operators


#: Pages shorter than this are kept with their elements, the last 512 of a worker.
KEPT_CHARS = 16_000


@lru_cache(maxsize=512)
def _kept_elements(page: str) -> list[tuple[str, str, bool]]:
    return marked_elements(page)


def page_elements(pages: DataFrame, key: str = "page_id", text: str = "page") -> DataFrame:
    """(key, elem_no int from 1, kind, content, main) of the elements of each page; null, blank and plain pages give no row.
    ``main`` says whether the tag-path ratios make its node content, not frame.

    Repeated rows of a key count once; should its pages differ, the elements of each come out.  Pages are parsed where
    they are read, and only elements are shuffled.  Other columns, whatever their names, are not read.
    """
    src = pages.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, found = [], [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                # a short page may be one of many copies
                own = _kept_elements(page) if page and len(page) < KEPT_CHARS else marked_elements(page)
                at += [i] * len(own)
                number += range(1, len(own) + 1)
                found += own
            if at:
                kinds, contents, main = zip(*found, strict=True)
                columns = [batch.column(0).take(pa.array(at)), pa.array(number, pa.int32()), pa.array(kinds), pa.array(contents, pa.string()), pa.array(main)]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "elem_no", "kind", "content", "main"])

    names = [("elem_no", T.IntegerType()), ("kind", T.StringType()), ("content", T.StringType()), ("main", T.BooleanType())]
    return src.mapInArrow(run, T.StructType([src.schema["k"], *(T.StructField(*n) for n in names)])).distinct().withColumnRenamed("k", key)


def clean_texts(bodies: DataFrame, key: str = "page_id", text: str = "page") -> DataFrame:
    """(key, format, text) of each page: its format as told from the text, and its clean text (``main_text``).

    A null page has a null format and text, a blank one the format text and an empty text.
    """
    src = bodies.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(1).to_pylist()
            formats = [None if p is None else page_format(p) for p in pages]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(formats, pa.string()), pa.array([main_text(p) for p in pages], pa.string())], names=["k", "format", "text"])

    fields = [src.schema["k"], T.StructField("format", T.StringType()), T.StructField("text", T.StringType())]
    return src.mapInArrow(run, T.StructType(fields)).withColumnRenamed("k", key)
