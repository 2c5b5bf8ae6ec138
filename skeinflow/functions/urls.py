"""Addresses: parts, normal form, links of pages, filters, row keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of links that are not followed.
SKIPPED_ENDINGS = ".jpg .jpeg .png .gif .txt".split()
#: Country codes of addresses that the language filter drops.
COUNTRY_CODES = """
ae al am ao ar az ba bd bh bj bn bo br bw by bz cd cf cg ci cl cn co cr cu cy dj do dz ec eg er et ge gh gm gn gq gt gw hk hn hr ht id il in iq ir jo jp ke kg kh km kp kr kw kz lb lk lr ls lt lu lv ly ma md mg mk ml mm mn mr mt mu mv mw mx my mz na ne ng ni np om pa pe pg ph pk pl pr ps py qa ro rs ru rw sa sb sd si sk sl sn so sr ss sv sy sz td tg th tj tm tn tr tt tw tz ua ug uy uz ve vn ye za zm zw
""".split()
#: Language codes of addresses that it drops ("en" is one of them).
LANGUAGE_CODES = """
af am ar az be bg bn bs ca ceb co cs cy da de el en eo es et eu fa fi fr fy ga gd gl gu ha haw he hi hmn hr ht hu hy id ig is it iw ja jw ka kk km kn ko ku ky la lb lo lt lv mg mi mk ml mn mr ms mt my ne nl no ny or pa pl ps pt ro ru rw sd si sk sl sm sn so sq sr st su sv sw ta te tg th tl tr uk ur uz vi xh yi yo zh zu
""".split()

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/:]*)(?::([^/]*))?(/.*)?$"


def url_parts(url: Column) -> Column:
    """struct(protocol, host, port, path); what has no protocol is all path, and a host without a path has path /."""
    absolute = url.rlike(_PARTS)

    def part(n: int) -> Column:
        return F.when(absolute, F.nullif(F.regexp_extract(url, _PARTS, n), F.lit("")))

    return F.struct(part(1).alias("protocol"), part(2).alias("host"), part(3).alias("port"), F.when(absolute, F.coalesce(part(4), F.lit("/"))).otherwise(url).alias("path"))


def composed(parts: Column) -> Column:
    """The address of such parts; a part that is null is left out."""
    start = F.when(parts["host"].isNotNull(), F.concat(F.coalesce(parts["protocol"], F.lit("")), F.lit("://"), parts["host"])).otherwise(F.lit(""))
    port = F.when(parts["port"].isNotNull(), F.concat(F.lit(":"), parts["port"])).otherwise(F.lit(""))
    return F.concat(start, port, F.coalesce(parts["path"], F.lit("")))


def without_fragment(url: Column) -> Column:
    """Up to ``#``; null for an address that is nothing else."""
    return F.when(~url.startswith("#"), F.substring_index(url, "#", 1))


def resolved_path(path: Column) -> Column:
    """Without ``.`` and ``..`` components; ``..`` at the top has no effect."""

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.regexp_replace(done, "/[^/]*$", "")).when(part == ".", done).otherwise(F.concat(done, F.lit("/"), part))

    return F.aggregate(F.split(F.regexp_replace(path, "^/", ""), "/"), F.lit(""), step)


def normalized(base: Column, link: Column, https_port: str = "443", http_port: str = "80", as_described: bool = False) -> Column:
    """The absolute address of a link on the page ``base``, with its port; null for a mere fragment and for other
    protocols than http and https.

    A port that is given stays, a relative link has its base's, and else the protocol's default is filled in; dots in the
    path are resolved.  ``as_described`` has the described job's way instead: every port is the protocol's default, and of
    dots only a leading ``..`` of a relative link is dropped.
    """
    target = without_fragment(link)
    own, above = url_parts(target), url_parts(base)
    absolute = own["protocol"].isNotNull()
    protocol = F.lower(F.coalesce(own["protocol"], above["protocol"]))
    host = F.when(absolute, own["host"]).otherwise(above["host"])
    default = F.when(protocol == "https", F.lit(https_port)).otherwise(F.lit(http_port))
    port = F.coalesce(F.when(absolute, own["port"]).otherwise(above["port"]), default)
    if as_described:
        port = default
    folder = F.regexp_replace(F.substring_index(above["path"], "?", 1), "[^/]*$", "")
    path = F.when(absolute | target.startswith("/"), own["path"]).when(target == "", above["path"]).otherwise(F.concat(folder, F.regexp_replace(target, r"^\.\./?", "") if as_described else target))
    address = F.concat(protocol, F.lit("://"), host, F.lit(":"), port, path if as_described else resolved_path(path))
    other = target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~absolute
    return F.when(protocol.isin("http", "https") & ~other, address)


def page_links(page: Column) -> Column:
    """Quoted href values of a page, line by line, in order and with repeats; skipped endings are left out."""
    lines = F.filter(F.split(page, "\n"), lambda x: x.contains("<") & x.contains(">"))
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit('(?i)(?:^| )href=[^" ]*"([^" ]*)'), F.lit(1))))
    keep = "(" + "|".join(e.replace(".", r"\.") for e in SKIPPED_ENDINGS) + ")$"
    return F.filter(found, lambda u: ~u.rlike(keep))


def passes_language(url: Column, extra_codes: list[str] | tuple[str, ...] = ()) -> Column:
    """Whether no part of the address is a country or language code; further codes are a parameter."""
    codes = sorted({*COUNTRY_CODES, *LANGUAGE_CODES, *extra_codes})
    return ~F.arrays_overlap(F.regexp_extract_all(url, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.array(*map(F.lit, codes)))


def row_key(text: Column) -> Column:
    """Row key of a text: two letters for each byte of its SHA-1, a-z and every other letter from a on.

    Bytes from 128 on count one less, and 0 as 255.
    """
    digest = F.sha1(text.cast("binary"))

    def letters(i: Column) -> Column:
        byte = F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        n = F.when(byte == 0, 255).when(byte > 127, byte - 1).otherwise(byte)
        return F.concat(F.chr(n % 26 + 97), F.chr(F.floor(n / 26) * 2 + 97))

    return F.when(text.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), letters), ""))


def like_pattern(pattern: Column) -> Column:
    """A LIKE pattern of one with ``*`` for any run of characters; both its ends are anchored."""
    escaped = F.regexp_replace(pattern, r"([%_\\])", r"\\$1")
    return F.regexp_replace(escaped, r"\*", "%")
