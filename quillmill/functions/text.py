"""Text columns: normalizers, question keys, residue detectors, style, score, code.

The four normalizers differ on purpose and must stay apart. All functions map
a Column to a Column of built-in expressions.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions import rules as R
from quillmill.functions.dialect import findall, folded, found, group_of, has, holds, java, let, literal, nfkc, replaced, strip, sub

NEWLINES = (("\r\n", "\n"), ("\r", "\n"))
#: What every literal outside ASCII needs.
WIDE = "[^\\x00-\\x{2dff}]"

# ---- normalizers ----


def normalize_chat(c: Column) -> Column:
    """Null gives ''; line ends to LF, U+3000 and runs of blanks to one space, blank lines to one."""
    c = replaced(F.coalesce(c, F.lit("")), *NEWLINES, ("　", " "))
    return strip(sub(F.regexp_replace(c, "[ \t]+", " "), r"\n\s*\n+", "\n\n"))


def normalize_row(c: Column) -> Column:
    """NFKC, U+2212 to '-', line ends to LF, strip; null stays null."""
    return strip(replaced(nfkc(c), ("−", "-"), *NEWLINES))


def normalize_answer(c: Column) -> Column:
    """Null gives ''; NFKC, U+2212, full-width marks to ASCII, currency signs deleted, strip."""
    c = replaced(nfkc(F.coalesce(c, F.lit(""))), ("−", "-"))
    return strip(F.translate(c, "，：．$¥￥", ",:."))


def strip_answer(c: Column) -> Column:
    """Strip; full-width marks to ASCII; currency signs, inline-math marks and braces deleted; strip."""
    c = F.translate(strip(c), "，：。$¥￥", ",:.")
    return strip(F.translate(replaced(c, ("\\(", ""), ("\\)", "")), "{}", ""))


def answer_key(c: Column) -> Column:
    """N3b, lower case, blanks and LF and TAB deleted, closing marks cut; null gives ''."""
    c = F.translate(F.lower(strip_answer(F.coalesce(c, F.lit("")))), " \n\t", "")
    return F.regexp_replace(c, r"[.,;:!？。；：]+\z", "")


def with_prefix(question: Column) -> Column:
    """N3d: N1 with the full-width question prefix."""
    q = normalize_chat(question)
    return F.when(q.startswith(R.QUESTION_PREFIX), q).otherwise(F.concat(F.lit(R.QUESTION_PREFIX), q))


def question_of(instruction: Column, input_: Column) -> Column:
    """N3e of normalized columns: the input without its prefix, else the instruction without boilerplate and prefix."""
    bare = lambda c: strip(sub(c, R.INPUT_PREFIX))
    return F.when(input_ != "", bare(input_)).otherwise(bare(strip(sub(instruction, R.BOILERPLATE, "", "s"))))


def question_key(c: Column) -> Column:
    """N1, one question prefix cut, lower case, white space and punctuation deleted."""
    c = F.lower(sub(normalize_chat(c), R.KEY_PREFIX, "", "i"))
    return F.regexp_replace(sub(c, r"\s+"), R.KEY_PUNCTUATION, "")


def dedup_text(c: Column) -> Column:
    """N2 with white space collapsed."""
    return sub(normalize_row(c), r"\s+", " ")


# ---- detectors ----


def _labels(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(label)) for c, label in pairs)))


def strict_residue(c: Column, class_rule: bool = True, keywords: bool = True) -> Column:
    """Labels of the strict rules (their patterns), then of the keywords. R2 without the class rule and keywords."""
    held = R.STRICT_RULES if class_rule else R.STRICT_RULES[:-1]

    def labels(low: Column) -> Column:
        words = let(low.rlike(WIDE), lambda wide: _labels([((F.lit(True) if k.isascii() else wide) & low.contains(k), f"KW:{k}") for k in R.KEYWORDS]))
        rules = _labels([(found(c, low, p, f), p) for p, f in held])
        return F.concat(rules, words) if keywords else rules

    # no keyword holds a letter that folding changes beyond lower case
    return let(folded(c), labels)


def named_residue(c: Column) -> Column:
    """Names of the named rules."""
    return let(folded(c), lambda low: _labels([(found(c, low, p, f), name) for name, p, f in R.NAMED_RULES]))


def has_fence(c: Column) -> Column:
    """F18."""
    return F.lower(c).contains("```")


# ---- style and score ----


def hint_count(low: Column) -> Column:
    """How many of the hints a lower-cased text holds, each counted once; the wide ones are looked for only where something is wide."""
    count = lambda hints: sum((low.contains(h).cast("int") for h in hints), F.lit(0))
    wide = [h for h in R.WORD_PROBLEM_HINTS if not h.isascii()]
    return count([h for h in R.WORD_PROBLEM_HINTS if h.isascii()]) + F.when(low.rlike(WIDE), count(wide)).otherwise(0)


def _any_of(c: Column, low: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any of the patterns matches, case ignored; literals by plain search, wide ones only where something is wide."""

    def each(some: list[str]) -> Column:
        return reduce(or_, (low.contains(literal(p)) if literal(p) else found(c, low, p, "i") for p in some))

    wide = [p for p in patterns if not p.isascii()]
    return each([p for p in patterns if p.isascii()]) | (c.rlike(WIDE) & each(wide))


def style(question: Column) -> Column:
    """Y1."""

    def told(low: Column) -> Column:
        unit = reduce(or_, (low.contains(u) for u in R.UNITS))
        return F.when(let(folded(low), lambda x: _any_of(low, x, R.ADVANCED_PATTERNS)), "mathstyle").when((hint_count(low) >= 2) | unit, "gsm8kstyle").otherwise("general")

    return let(F.lower(question), told)


def quality_score(question: Column, full: Column, ablated: Column, turns: Column, has_code: Column, had_system: Column) -> Column:
    """Y2."""
    points = (
        (had_system, 2), (turns.isin(3, 5), 2), (has_code, 1), (full.contains("\\boxed"), 2), (F.length(question) >= 8, 1),
        (F.length(full) >= 80, 2), (F.length(ablated) >= 50, 1), (F.length(full) > 5000, -2),
    )
    return sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0))


# ---- code ----


def has_code(c: Column) -> Column:
    """F16."""
    return has(c, "```python", "i") | has(c, R.FENCED, "i")


def execution_result(c: Column) -> Column:
    """Bodies of all fences, else the text, without the lead-ins."""
    c = normalize_chat(c)
    bodies = F.filter(F.transform(findall(c, R.FENCE_BODY, 1), strip), lambda x: x != "")
    found = F.when(has(c, R.FENCE_BODY), F.array_join(bodies, "\n")).otherwise(c)
    return normalize_chat(F.btrim(replaced(found, *((p, "") for p in R.LEAD_INS)), F.lit("` \n")))


def without_blocks(c: Column) -> Column:
    """C4: complete fences go, then from an orphan fence to the end."""
    bare = lambda x: F.when(x.contains("```"), normalize_chat(sub(sub(x, R.FENCED, "", "i"), R.ORPHAN_FENCE, "", "i"))).otherwise(x)
    return let(normalize_chat(c), bare)


def _kept_lines(c: Column, bad) -> Column:
    """Lines whose stripped form isn't bad; blank ones become empty."""
    pairs = F.transform(F.split(c, "\n"), lambda x: F.struct(x.alias("line"), strip(x).alias("bare")))
    kept = F.filter(pairs, lambda x: (x["bare"] == "") | ~bad(x["bare"]))
    return F.array_join(F.transform(kept, lambda x: F.when(x["bare"] == "", "").otherwise(x["line"])), "\n")


def _holds(c: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds any of the words; the wide ones are looked for only where something is wide."""
    some = lambda low, own: reduce(or_, (low.contains(w) for w in own), F.lit(False))
    ascii_, wide = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
    return let(F.lower(c), lambda low: some(low, ascii_) | (low.rlike(WIDE) & some(low, wide)))


def ablated(c: Column) -> Column:
    """C4, phrases deleted in order, code-like lines and hint lines dropped, left fragments dropped.

    What the whole text lacks is not looked for in its lines.
    """

    def without_phrases(x: Column) -> Column:
        out = x
        for p in R.PHRASES:
            out = sub(out, p, "", "i")
        # every phrase holds one of these, so most texts skip all 22 passes
        return F.when(_holds(x, ("python", "运行上述代码", "运行以上代码")), out).otherwise(x)

    def without_code(x: Column) -> Column:
        """Blank lines are settled by normalizing, so texts without anything to drop stay whole."""
        codes = ("```", *R.CODE_LINES)
        # what no part of the text matches no line does; a line's beginning is another matter
        bits = F.array(_holds(x, R.LINE_HINTS), *(holds(x, x, p) if p.startswith("^") else found(x, x, p) for p in codes))

        def kept(bits: Column) -> Column:
            lines = _kept_lines(x, lambda line: (bits[0] & _holds(line, R.LINE_HINTS)) | reduce(or_, (bits[k] & found(line, line, p) for k, p in enumerate(codes, 1))))
            return F.when(F.exists(bits, lambda b: b), lines).otherwise(x)

        return let(bits, kept)

    def without_fragments(x: Column) -> Column:
        return F.when(_holds(x, R.FRAGMENTS), _kept_lines(x, lambda line: _holds(line, R.FRAGMENTS))).otherwise(x)

    def settled(x: Column, change) -> Column:
        """The changed text in normal form; ``x`` is in it already."""
        return let(change(x), lambda y: F.when(y == x, x).otherwise(normalize_chat(y)))

    stripped = let(without_blocks(c), lambda x: settled(x, lambda x: let(without_phrases(x), without_code)))
    return let(stripped, lambda x: settled(x, without_fragments))


def first_code(c: Column) -> Column:
    """The stripped body of the first python fence; null without one or if blank."""
    return F.nullif(strip(group_of(c, R.PYTHON_BLOCK, 1, "si")), F.lit(""))


def last_code(c: Column) -> Column:
    """The last fence's body, else a bare python section up to a conclusion; '' without."""
    blocks = findall(F.coalesce(c, F.lit("")), R.ANY_BLOCK, 1, "si")
    bare = group_of(c, R.BARE_PYTHON, 1, "si")
    return F.when(F.size(blocks) > 0, strip(F.try_element_at(blocks, F.lit(-1)))).otherwise(F.coalesce(strip(bare), F.lit("")))


def without_execution(c: Column) -> Column:
    """Execution sections, then result fluff, each up to a conclusion, give way to LF."""
    return sub(sub(c, R.EXECUTION_SECTION, "\n", "si"), R.RESULT_FLUFF, "\n", "si")


def reasoning(c: Column) -> Column:
    """C9 of a normalized, NFKC-stable text: the text before the first python block, and that block fenced anew.

    The trimmed text, its code and what stands before are each made once.
    """

    def before(c: Column) -> Column:
        held = strip(replaced(F.regexp_extract(c, java(r"^(.*?)```python\s*.*?```", "si"), 1), ("−", "-"), *NEWLINES))
        for p, flags in R.TEMPLATE_PHRASES:
            held = sub(held, p, "", flags)
        return strip(held)

    def joined(c: Column, code: Column) -> Column:
        block = F.concat(F.lit("```python\n"), code, F.lit("\n```"))
        return F.when(code.isNull(), c).otherwise(let(before(c), lambda b: F.when(b != "", F.concat(b, F.lit("\n\n"), block)).otherwise(block)))

    return let(without_execution(c), lambda x: let(first_code(x), lambda code: joined(x, code)))


def clean_output(core: Column, answer: Column) -> Column:
    """C10."""
    final = F.concat(F.lit("Final Answer: "), answer)
    return F.when(core != "", F.concat(core, F.lit("\n\n"), final)).otherwise(final)
