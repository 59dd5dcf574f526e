"""Regular expressions with Python's meaning, as Java patterns and as RE2 ones.

Patterns are written as for Python's ``re`` on str. White space is spelled out
as the set that str.isspace knows, so both engines agree with Python on it.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from functools import reduce
from operator import and_, or_
from re import _constants, _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: str.isspace as a class body; the syntax suits Java and RE2.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What str.splitlines cuts at, CRLF aside.
LINE_ENDS = r"\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}"
WORD_CLASS = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def _common(pattern: str) -> str:
    return pattern.replace(r"[\s\S]", "(?s:.)").replace(r"\s", f"[{SPACES}]")


def java(pattern: str, flags: str = "") -> str:
    """``flags`` as in Python: i, m, s. ``(?dU)`` gives LF-only line ends and Unicode classes."""
    own = "dU" + "".join({"i": "iu", "m": "m", "s": "s"}[f] for f in flags)
    return f"(?{own})" + _common(pattern).replace(r"\Z", r"\z")


def re2(pattern: str, flags: str = "") -> str:
    """For tests of existence: a word boundary at either end consumes a neighbour."""
    p = _common(pattern).replace(r"\w", WORD_CLASS).replace(r"\d", r"\p{Nd}").replace(r"\Z", r"\z")
    if p.startswith(r"\b"):
        p = f"(?:^|{NOT_WORD})" + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + (f"(?:$|{NOT_WORD})" if p[-3].isalnum() else WORD_CLASS)
    return (f"(?{flags})" if flags else "") + p


def has(c: Column, pattern: str, flags: str = "") -> Column:
    return c.rlike(java(pattern, flags))


# ---- required factors: what a match must hold, found by plain search first ----


def _needed(parsed) -> list[tuple[str, ...]]:
    out, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is _constants.LITERAL:
            run += chr(value)
            continue
        if run:
            out.append((run,))
            run = ""
        if op is _constants.SUBPATTERN:
            out += _needed(value[-1])
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0] > 0:
            out += _needed(value[2])
        elif op is _constants.BRANCH:
            parts = [_needed(x) for x in value[1]]
            if all(parts):
                out.append(tuple(f for x in parts for f in max(x, key=lambda any_of: min(map(len, any_of)))))
    return out


@functools.cache
def factors(pattern: str, flags: str = "") -> tuple[tuple[str, ...], ...]:
    """All of these are in any text that the pattern matches, of each one or more; the longest first. Lower-cased under the flag i."""
    found = {tuple(dict.fromkeys(f.lower() if "i" in flags else f for f in any_of)) for any_of in _needed(_parser.parse(pattern))}
    return tuple(sorted(found, key=lambda any_of: (-min(map(len, any_of)), len(any_of), any_of)))


def literal(pattern: str) -> str | None:
    """The text that the pattern is, if it is one."""
    parsed = list(_parser.parse(pattern))
    return "".join(chr(value) for _, value in parsed) if all(op is _constants.LITERAL for op, _ in parsed) else None


def folded(c: Column) -> Column:
    """Lower case, and the two letters besides that equal ASCII ones when case is ignored."""
    return let(F.lower(c), lambda low: F.when(low.rlike("[ſı]"), F.translate(low, "ſı", "si")).otherwise(low))


def holds(c: Column, low: Column, pattern: str, flags: str = "") -> Column:
    """Whether the text has what a match needs; ``low`` is the folded text."""
    where = low if "i" in flags else c
    return reduce(and_, (reduce(or_, (where.contains(f) for f in any_of)) for any_of in factors(pattern, flags)), F.lit(True))


def found(c: Column, low: Column, pattern: str, flags: str = "") -> Column:
    """``has``, but the expression runs only on texts that hold its factors."""
    return holds(c, low, pattern, flags) & has(c, pattern, flags)


def sub(c: Column, pattern: str, to: str = "", flags: str = "") -> Column:
    return F.regexp_replace(c, java(pattern, flags), to)


def findall(c: Column, pattern: str, group: int = 0, flags: str = "") -> Column:
    return F.regexp_extract_all(c, F.lit(java(pattern, flags)), F.lit(group))


def group_of(c: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """The group of the first match; null without a match, where regexp_extract gives ''."""
    return F.when(has(c, pattern, flags), F.regexp_extract(c, java(pattern, flags), group))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def last(items: Column) -> Column:
    """The last element; null of an empty array."""
    return F.try_element_at(items, F.lit(-1))


#: The same set as characters.
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(c: Column) -> Column:
    """str.strip: white space in Unicode's sense at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def lines_of(c: Column) -> Column:
    """str.splitlines, without its rule for a final line end: callers drop blank lines."""
    return F.split(c, rf"\r\n|[{LINE_ENDS}]")


def _ranges(wanted, least: int = 1, end: int = sys.maxunicode + 1) -> str:
    """A class body of the runs of ``least`` and more code points that are ``wanted``."""
    out, begin = [], None
    for cp in range(end + 1):
        own = cp < end and not 0xD800 <= cp <= 0xDFFF and wanted(chr(cp))
        if own and begin is None:
            begin = cp
        elif not own and begin is not None:
            if cp - begin >= least or begin < 256:
                out.append(f"\\x{{{begin:x}}}-\\x{{{cp - 1:x}}}")
            begin = None
    return "".join(out)


@functools.cache
def _settled() -> str:
    """Long runs of characters of the plane in common use that NFKC leaves alone and never joins to the one before."""
    joins = {unicodedata.normalize("NFD", chr(c))[-1:] for c in range(0x3400) if len(unicodedata.normalize("NFD", chr(c))) > 1}
    hangul = range(0x1100, 0x1200)
    plain = lambda c: unicodedata.category(c) != "Cn" and unicodedata.combining(c) == 0 and unicodedata.normalize("NFKC", c) == c and c not in joins and ord(c) not in hangul
    return _ranges(plain, 200, 0x10000)


@functools.cache
def _unassigned() -> str:
    return _ranges(lambda c: unicodedata.category(c) == "Cn")


def nfkc(c: Column) -> Column:
    """Unicode NFKC by the library that Spark's collations use.

    Texts in common characters pass at once. Characters that Python's tables don't
    know yet stay as they are and bound what is normalized, as they do there.
    """

    def composed(x: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    known = rf"[^{_unassigned()}]+"
    parts = F.regexp_extract_all(c, F.lit(rf"{known}|[{_unassigned()}]+"), F.lit(0))
    by_part = F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^{known}"), composed(x)).otherwise(x)), "")
    odd = F.regexp_replace(c, f"[{_settled()}]+", "")
    return F.when(c.isNull() | (odd == ""), c).when(odd.rlike(f"[{_unassigned()}]"), by_part).otherwise(composed(c))
