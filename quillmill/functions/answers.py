"""Final answers in four dialects, which differ on purpose, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions import rules as R
from quillmill.functions.dialect import findall, group_of, has, java, last, let, lines_of, replaced, strip
from quillmill.functions.numbers import as_double, canonical, is_close, last_plain_number, parse_last_number
from quillmill.functions.text import answer_key, normalize_answer, normalize_row, strip_answer


def _lines(c: Column) -> Column:
    return F.filter(F.transform(lines_of(c), strip), lambda x: x != "")


def _numbers(c: Column) -> Column:
    return F.transform(findall(replaced(c, (",", "")), R.NUMBER), canonical)


def clean_answer(c: Column, normalized: bool = False) -> Column:
    """All boxed numbers, else a final phrase's numbers or text, else the last of five lines with numbers; null without."""
    c = c if normalized else normalize_row(c)
    joined = lambda items, other: let(items, lambda x: F.when(F.size(x) > 0, F.array_join(x, ", ")).otherwise(other))
    boxed = joined(F.array_compact(F.transform(findall(c, R.BOXED, 1), lambda x: last(_numbers(x)))), F.lit(None))
    phrases = [let(strip(group_of(c, p, 1, flags)), lambda part: F.when(part.isNotNull(), joined(_numbers(part), part))) for p, flags in R.CLEAN_FINAL]
    tail = let(_lines(c), lambda x: F.slice(x, F.greatest(F.size(x) - 4, F.lit(1)), 5))
    told = F.filter(F.transform(tail, lambda x: F.array_join(_numbers(x), ", ")), lambda x: x != "")
    return F.coalesce(boxed, *phrases, last(told))


def final_segment(c: Column, normalized: bool = False) -> Column:
    """E2's segment: last boxed, last hashed, first final phrase, last line."""
    c = c if normalized else normalize_answer(c)
    again = lambda x: strip(F.translate(x, "$¥￥", ""))  # noqa: E731  the text is normalized already
    boxed, hashed = findall(c, R.BOXED, 1), findall(c, R.HASHED, 1)
    found = F.when(F.size(boxed) > 0, again(last(boxed))).when(F.size(hashed) > 0, again(last(hashed)))
    for p, flags in R.SEGMENT_FINAL:
        found = found.when(has(c, p, flags), again(F.regexp_extract(c, java(p, flags), 1)))
    return found.otherwise(F.coalesce(last(_lines(c)), c))


def number_of(segment: Column, c: Column) -> Column:
    """The segment's first number, else the last of its normalized text, else ''."""
    return F.coalesce(F.try_element_at(findall(segment, R.NUMBER), F.lit(1)), last(findall(c, R.NUMBER)), F.lit(""))


def final_number(c: Column, normalized: bool = False) -> Column:
    """E2 of a text."""
    c = c if normalized else normalize_answer(c)
    return number_of(final_segment(c, True), c)


def simple_answer(c: Column) -> Column:
    """The last boxed number, else the last number after a final phrase, else the last number; null without."""
    found = F.coalesce(last_plain_number(last(findall(c, R.BOXED_LOOSE, 1))), *(last(findall(c, p, 1, "i")) for p in R.SIMPLE_FINAL))
    return F.coalesce(found, last_plain_number(c))


def analysis_answer(c: Column) -> Column:
    """Last boxed, last hashed, last of each final phrase, last number, last line, else ''."""
    c = strip(F.coalesce(c, F.lit("")))
    boxed, hashed = findall(c, R.BOXED, 1), findall(c, R.HASHED, 1)
    found = F.coalesce(last(boxed), last(hashed), *(last(findall(c, p, 1, f)) for p, f in R.ANALYSIS_FINAL), last(findall(replaced(c, (",", "")), R.NUMBER)), last(_lines(c)))
    return F.coalesce(strip_answer(found), F.lit(""))


def told_equal(pred: tuple[Column, Column], gold: tuple[Column, Column]) -> Column:
    """E5 of (segment, number) each: the numbers where both are some, else the segments."""
    a, b = (as_double(replaced(number, (",", ""))) for _, number in (pred, gold))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), is_close(x["a"], x["b"])).otherwise(pred[0] == gold[0]))


def segments_equal(pred: Column, gold: Column, normalized: bool = False) -> Column:
    """E5 of texts."""
    p, g = (x if normalized else normalize_answer(x) for x in (pred, gold))
    return told_equal(*((final_segment(x, True), final_number(x, True)) for x in (p, g)))


def analysis_equal(pred: Column, gold: Column) -> Column:
    """E6."""
    a, b = parse_last_number(pred), parse_last_number(gold)
    return F.when(a.isNotNull() & b.isNotNull(), is_close(a, b)).otherwise(answer_key(pred) == answer_key(gold))
