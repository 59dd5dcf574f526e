"""Numbers: parsing, canonical text, comparison. All built-in expressions.

As in Python's float(), digits of any script are digits and single underscores
may stand between them.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions import rules as R
from quillmill.functions.dialect import findall, last, let, replaced, strip
from quillmill.functions.text import normalize_answer, strip_answer

DIGITS = r"[0-9](?:_?[0-9])*"
FLOAT = rf"(?i)^[+-]?(?:{DIGITS}\.?(?:{DIGITS})?|\.{DIGITS})(?:e[+-]?{DIGITS})?$"
NAMED = r"(?i)^[+-]?(?:inf|infinity|nan)$"
FRACTION = rf"^[+-]?{DIGITS}/{DIGITS}$"
#: The decimal digits of all scripts but ASCII's.
OTHER_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
VALUES = "".join(str(unicodedata.digit(c)) for c in OTHER_DIGITS)


def ascii_digits(c: Column) -> Column:
    """Digits of any script as ASCII ones; ASCII texts pass at once."""
    return F.when(c.rlike("^[\\x00-\\x7F]*$"), c).otherwise(F.translate(c, OTHER_DIGITS, VALUES))


def as_double(c: Column) -> Column:
    """N4's core on text without commas: int/int or a float's text, else null; 3/0 is null."""

    def read(c):
        bare = replaced(c, ("_", ""))
        top, bottom = F.split(bare, "/")[0].try_cast("double"), F.try_element_at(F.split(bare, "/"), F.lit(2)).try_cast("double")
        signed = F.when(c.startswith("-"), -1.0).otherwise(1.0)
        named = F.when(F.lower(c).contains("nan"), F.lit(float("nan"))).otherwise(signed * F.lit(float("inf")))
        return F.when(c.rlike(FRACTION), F.try_divide(top, bottom)).when(c.rlike(FLOAT), bare.try_cast("double")).when(c.rlike(NAMED), named)

    return let(ascii_digits(c), read)


def parse_number(c: Column) -> Column:
    """Of a whole answer text."""
    return as_double(replaced(normalize_answer(c), (",", "")))


def parse_last_number(c: Column) -> Column:
    """Of the last number in a text; null text gives null."""
    return as_double(last(findall(replaced(strip_answer(c), (",", "")), R.NUMBER)))


def last_plain_number(c: Column) -> Column:
    """The text of the last signed decimal, else null."""
    return last(findall(replaced(strip(c), (",", "")), R.PLAIN_NUMBER))


def canonical(c: Column) -> Column:
    """N7 of a matched number's text: commas go, and a final .0 with the sign and zeros that int() drops."""
    c = replaced(c, (",", ""))
    whole = F.regexp_replace(F.regexp_replace(c, r"\.0$", ""), r"^([+-]?)0*(?=[0-9])", "$1")
    whole = F.when(whole.isin("-0", "+0"), "0").otherwise(F.regexp_replace(whole, r"^\+", ""))
    return F.when(c.rlike(r"^[+-]?[0-9]+\.0$"), whole).otherwise(c)


def rounded(c: Column, digits: int) -> Column:
    """round(x, digits) as Python has it: the binary value's nearest, ties to even.

    The product with 10**digits is taken with its rounding error (two factors,
    split in halves), so a tie is one only if the binary value is.
    """
    scale = float(10**digits)

    def halves(x):
        big = x * 134217729.0
        return big - (big - x)

    def of(x):
        p = x * scale
        xh, sh = halves(x), halves(F.lit(scale))
        xl, sl = x - xh, scale - sh
        error = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
        low = F.floor(p).cast("double")
        over = p - low
        up = (over > 0.5) | ((over == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(low, F.lit(2.0)) == 1))))
        return F.when(p < 2.0**52, (low + up.cast("double")) / scale).otherwise(x)

    size = F.abs(c.cast("double"))
    return F.when(F.isnan(c.cast("double")) | (size == float("inf")), c.cast("double")).otherwise(F.signum(c.cast("double")) * let(size, of))


def is_close(a: Column, b: Column, tolerance: float = R.TOLERANCE) -> Column:
    """Math.isclose with the tolerance both relative and absolute."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    near = F.abs(a - b) <= F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))
    return F.when(F.isnan(a) | F.isnan(b), False).otherwise((a == b) | (finite(a) & finite(b) & near))


def equal_or_text(pred: Column, gold: Column, tolerance: float = R.TOLERANCE) -> Column:
    """Strictly nearer than the tolerance; texts compare where either isn't a number, null gold as 'None'."""
    p, g = as_double(strip(pred)), as_double(strip(gold))
    p, g = (F.when(~x.rlike(FRACTION), v) for x, v in ((strip(pred), p), (strip(gold), g)))
    texts = strip(F.coalesce(pred, F.lit("None"))) == strip(F.coalesce(gold, F.lit("None")))
    return F.when(p.isNotNull() & g.isNotNull(), ~F.isnan(p) & ~F.isnan(g) & (F.abs(p - g) < tolerance)).otherwise(texts)
