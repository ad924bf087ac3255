"""Text expressions: one definition of white space, tokens, lines and identifiers for every operator."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, shared with the SQL that checks them.
TOKEN = r"[\p{L}\p{N}]+"
SPACE = r"[ \t\n\x0B\f\r]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
HEX40 = r"\b[0-9a-f]{40}\b"
DIGITS16 = r"\b[0-9]{16}\b"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
IDENTIFIERS = {"email": EMAIL, "hex40": HEX40, "digits16": DIGITS16, "ipv4": IPV4}
DB_NAME = r"\A[A-Za-z0-9][A-Za-z0-9_.-]*-rag\z"
UUID = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
DOCUMENT_PREFIX = "検索文書: "
QUERY_PREFIX = "検索クエリ: "


def find_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return find_all(F.lower(c), TOKEN)


def collapse(c: Column) -> Column:
    """Each run of ASCII white space becomes one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def blank(c: Column) -> Column:
    """Nothing but white space of any script."""
    return c.rlike(r"(?U)\A\s*\z")


def lines(c: Column) -> Column:
    """Lines with anything but white space, in order; CRLF, LF and CR end a line."""
    return F.filter(F.split(c, r"\r\n|\n|\r"), lambda x: F.length(F.trim(F.regexp_replace(x, SPACE, " "))) > 0)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


@functools.cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Unicode's full case folding, by the rule of the standard library: letters that fold to one letter, and those that fold to several."""
    changed = {chr(c): chr(c).casefold() for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)}
    return {c: f for c, f in changed.items() if len(f) == 1}, {c: f for c, f in changed.items() if len(f) > 1}


#: Alphabets of which nearly all letters fold to their small letters, and scripts and signs that have no case.
_PLAIN = ((0x0, 0x24F), (0x370, 0x52F), (0x2000, 0x206F), (0x3000, 0x9FFF), (0xAC00, 0xD7A3))


@functools.cache
def _not_plain() -> str:
    """What folding and small letters differ on: letters outside of _PLAIN, some inside it, and the letter whose small form depends on its place."""
    other = [c for low, high in _PLAIN for c in range(low, high + 1) if chr(c).casefold() != chr(c).lower() and chr(c) != "ß"]
    span = lambda low, high: rf"\x{{{low:X}}}-\x{{{high:X}}}"
    return "[^" + "".join(span(*r) for r in _PLAIN) + "]|[\u03a3\u0130" + "".join(span(c, c) for c in other) + "]"


def casefold(c: Column) -> Column:
    """Full case folding. Most texts fold to their small letters, with two for the sharp s; letter by letter go the others, and those without one of the
    letters that fold to several are not looked at for them one by one."""
    one, several = _folds()
    more = c
    for letter, folded in several.items():
        more = F.replace(more, F.lit(letter), F.lit(folded))
    some = F.when(c.rlike(f"[{''.join(several)}]"), more).otherwise(c)
    return F.when(~c.rlike(_not_plain()), F.lower(F.replace(c, F.lit("ß"), F.lit("ss")))).otherwise(F.translate(some, "".join(one), "".join(one.values())))


def glob_regex(glob: str) -> str:
    """A path glob as an anchored regular expression: * and ? stay inside a folder, ** does not."""
    import re

    if glob.startswith("/") or re.match(r"[A-Za-z]:|\\\\", glob) or ".." in glob.split("/"):
        raise ValueError("globs are relative to the root of their source")
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return rf"\A{out}\z"


def sha(c: Column) -> Column:
    return F.sha2(c, 256)
