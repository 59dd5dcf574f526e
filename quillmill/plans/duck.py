"""DuckDB expressions for the queries' SQL: text in, text out.

Written for RE2: no lookahead, ASCII word boundaries (see ``dialect.re2``).
"""

from __future__ import annotations

import re

from quillmill.functions import rules as R
from quillmill.functions.dialect import LINE_ENDS, SPACES, re2

NL = "chr(10)"
NUM = re2(R.NUMBER)
PLAIN = re2(R.PLAIN_NUMBER)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def sub(x: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {to}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def findall(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def newlines(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), {NL}), chr(13), {NL})"


def n1(x: str) -> str:
    blanks = sub(f"replace({newlines(f"coalesce({x}, '')")}, '　', ' ')", r"[ \t]+", "' '")
    return strip(sub(blanks, rf"\n[{SPACES}]*\n+", f"{NL} || {NL}"))


def n2(x: str) -> str:
    """Of texts that NFKC changes in full-width colons and commas only."""
    return strip(newlines(f"replace(translate({x}, '：，', ':,'), '−', '-')"))


def n3(x: str) -> str:
    return strip(f"translate(replace(coalesce({x}, ''), '−', '-'), '，：．$¥￥', ',:.')")


def n3b(x: str) -> str:
    return strip(f"translate(replace(replace(translate({strip(x)}, '，：。$¥￥', ',:.'), '\\(', ''), '\\)', ''), '{{}}', '')")


def n3c(x: str) -> str:
    bare = f"lower({n3b(f"coalesce({x}, '')")})"
    return sub(f"translate({bare}, ' ' || {NL} || chr(9), '')", "[.,;:!？。；：]+$")


def prefixed(x: str) -> str:
    return f"CASE WHEN starts_with({n1(x)}, '题目：') THEN {n1(x)} ELSE '题目：' || {n1(x)} END"


def key(x: str) -> str:
    low = f"lower({sub(n1(x), f'(?i)^[{SPACES}]*(题目[:：][{SPACES}]*)')})"
    return sub(sub(low, f"[{SPACES}]+"), R.KEY_PUNCTUATION)


def strict(x: str, class_rule: bool = True, keywords: bool = True) -> str:
    held = R.STRICT_RULES if class_rule else R.STRICT_RULES[:-1]
    parts = [f"CASE WHEN {has(x, re2(p, f))} THEN {q(p)} END" for p, f in held]
    parts += [f"CASE WHEN contains(lower({x}), {q(k)}) THEN {q('KW:' + k)} END" for k in R.KEYWORDS if keywords]
    return f"list_filter([{', '.join(parts)}], lambda v: v IS NOT NULL)"


def named(x: str) -> str:
    parts = []
    for name, p, f in R.NAMED_RULES:
        alternatives = [re2(a, f) for a in (p.split("|^") if name == "import_stmt" else [p])]
        alternatives = [a if k == 0 else a.replace("(?m)", "(?m)^", 1) for k, a in enumerate(alternatives)]
        parts.append("CASE WHEN " + " OR ".join(has(x, a) for a in alternatives) + f" THEN {q(name)} END")
    return f"list_filter([{', '.join(parts)}], lambda v: v IS NOT NULL)"


def hints(low: str) -> str:
    return "(" + " + ".join(f"contains({low}, {q(h)})::INT" for h in R.WORD_PROBLEM_HINTS) + ")"


def style(x: str) -> str:
    low = f"lower({x})"
    advanced = "|".join(f"(?:{re2(p)})" for p in R.ADVANCED_PATTERNS)
    return f"CASE WHEN {has(low, '(?i)' + advanced)} THEN 'mathstyle' WHEN {hints(low)} >= 2 OR {has(low, '|'.join(R.UNITS))} THEN 'gsm8kstyle' ELSE 'general' END"


def c3(x: str) -> str:
    bodies = f"list_filter(list_transform({findall(n1(x), re2(R.FENCE_BODY), 1)}, lambda b: {strip('b')}), lambda b: b <> '')"
    found = f"CASE WHEN {has(n1(x), re2(R.FENCE_BODY))} THEN array_to_string({bodies}, {NL}) ELSE {n1(x)} END"
    for p in R.LEAD_INS:
        found = f"replace({found}, {q(p)}, '')"
    return n1(f"trim({found}, '` ' || {NL})")


def c4(x: str) -> str:
    return n1(sub(sub(n1(x), "(?i)" + re2(R.FENCED)), "(?i)" + re2(R.ORPHAN_FENCE)))


def _kept(x: str, bad: str) -> str:
    pairs = f"list_transform(string_split({x}, {NL}), lambda l: struct_pack(line := l, bare := {strip('l')}))"
    kept = f"list_filter({pairs}, lambda s: s.bare = '' OR NOT ({bad}))"
    return f"array_to_string(list_transform({kept}, lambda s: CASE WHEN s.bare = '' THEN '' ELSE s.line END), {NL})"


def c5(x: str) -> str:
    out = c4(x)
    for p in R.PHRASES:
        out = sub(out, "(?i)" + re2(p))
    code = "|".join(f"(?:{re2(p)})" for p in ("```", *R.CODE_LINES))
    words = lambda ws: "|".join(re.escape(w) for w in ws)
    out = n1(_kept(out, f"{has('lower(s.bare)', words(R.LINE_HINTS))} OR {has('s.bare', code)}"))
    return n1(_kept(out, has("lower(s.bare)", words(R.FRAGMENTS))))


def canonical(x: str) -> str:
    bare = f"replace({x}, ',', '')"
    whole = f"CAST(TRY_CAST(regexp_replace({bare}, '\\.0$', '') AS HUGEINT) AS VARCHAR)"
    return f"CASE WHEN regexp_matches({bare}, '^[+-]?[0-9]+\\.0$') THEN {whole} ELSE {bare} END"


def numbers(x: str) -> str:
    return f"list_transform({findall(f"replace({x}, ',', '')", NUM)}, lambda n: {canonical('n')})"


def as_double(x: str) -> str:
    part = lambda k: f"TRY_CAST(split_part({x}, '/', {k}) AS DOUBLE)"
    fraction = f"CASE WHEN {part(2)} <> 0 THEN {part(1)} / {part(2)} END"
    return f"CASE WHEN regexp_matches({x}, '^[+-]?[0-9]+/[0-9]+$') THEN {fraction} WHEN regexp_matches({x}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN TRY_CAST({x} AS DOUBLE) END"


def close(a: str, b: str) -> str:
    return f"({a} = {b} OR abs({a} - {b}) <= greatest(1e-6 * greatest(abs({a}), abs({b})), 1e-6))"


def lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\r\\n|[{LINE_ENDS}]'), lambda l: {strip('l')}), lambda l: l <> '')"


def e1(x: str) -> str:
    """Of a normalized column."""
    boxed = f"list_filter(list_transform({findall(x, re2(R.BOXED), 1)}, lambda b: {numbers('b')}[-1]), lambda b: b IS NOT NULL)"
    out = f"CASE WHEN len({boxed}) > 0 THEN array_to_string({boxed}, ', ')"
    for p, f in R.CLEAN_FINAL:
        seg = strip(f"regexp_extract({x}, {q(re2(p, f))}, 1)")
        out += f" WHEN {has(x, re2(p, f))} THEN CASE WHEN len({numbers(seg)}) > 0 THEN array_to_string({numbers(seg)}, ', ') ELSE {seg} END"
    told = f"list_filter(list_transform({lines(x)}[-5:], lambda l: array_to_string({numbers('l')}, ', ')), lambda l: l <> '')"
    return f"{out} ELSE {told}[-1] END"


def e2_segment(x: str) -> str:
    again = lambda y: strip(f"translate({y}, '$¥￥', '')")
    boxed, hashed = findall(x, re2(R.BOXED), 1), findall(x, re2(R.HASHED), 1)
    out = f"CASE WHEN len({boxed}) > 0 THEN {again(boxed + '[-1]')} WHEN len({hashed}) > 0 THEN {again(hashed + '[-1]')}"
    for p, f in R.SEGMENT_FINAL:
        out += f" WHEN {has(x, re2(p, f))} THEN {again(f'regexp_extract({x}, {q(re2(p, f))}, 1)')}"
    return f"{out} ELSE coalesce({lines(x)}[-1], {x}) END"


def e2_number(segment: str, x: str) -> str:
    return f"coalesce({findall(segment, NUM)}[1], {findall(x, NUM)}[-1], '')"


def n6(x: str) -> str:
    return f"{findall(f"replace({strip(x)}, ',', '')", PLAIN)}[-1]"


def e3(x: str) -> str:
    found = [n6(f"{findall(x, re2(R.BOXED_LOOSE), 1)}[-1]")] + [f"{findall(x, re2(p, 'i'), 1)}[-1]" for p in R.SIMPLE_FINAL]
    return f"coalesce({', '.join(found)}, {n6(x)})"


def e4(x: str) -> str:
    x = strip(f"coalesce({x}, '')")
    found = [f"{findall(x, re2(R.BOXED), 1)}[-1]", f"{findall(x, re2(R.HASHED), 1)}[-1]"]
    found += [f"{findall(x, re2(p, f), 1)}[-1]" for p, f in R.ANALYSIS_FINAL]
    found += [f"{findall(f"replace({x}, ',', '')", NUM)}[-1]", f"{lines(x)}[-1]"]
    return f"coalesce({n3b(f'coalesce({", ".join(found)})')}, '')"


def n5(x: str) -> str:
    return as_double(f"({findall(f"replace({n3b(x)}, ',', '')", NUM)}[-1])")


def c1(x: str) -> str:
    p = "(?si)" + re2(R.PYTHON_BLOCK)
    return f"nullif(CASE WHEN {has(x, p)} THEN {strip(f'regexp_extract({x}, {q(p)}, 1)')} END, '')"


def c2(x: str) -> str:
    block = "(?si)" + re2(R.ANY_BLOCK)
    bare = rf"(?si)(?:^|\n)python[{SPACES}]*\n(.*?)(?:\n(?:因此|所以|答案|最终答案|输出|Output)|\n$)"
    return f"CASE WHEN len({findall(x, block, 1)}) > 0 THEN {strip(findall(x, block, 1) + '[-1]')} WHEN {has(x, bare)} THEN {strip(f'regexp_extract({x}, {q(bare)}, 1)')} ELSE '' END"


#: The terminator is captured and put back, as there is no lookahead.
_ENDS = rf"((?:\n[{SPACES}]*(?:因此|所以|综上|故|可得|最终答案|Final[{SPACES}]*Answer))|\z)"


def c8(x: str) -> str:
    first = r"(?si)(?:###[S]*)?(?:代码执行结果|运行结果|输出结果|程序输出|执行输出)[S]*[:：]?.*?" + _ENDS
    second = "(?si)(?:根据(?:以上|上述)?Python(?:代码)?(?:执行)?结果.*?|由(?:代码|程序)可得.*?|可见.*?)" + _ENDS
    return sub(sub(x, first.replace("[S]", f"[{SPACES}]"), r"chr(10) || '\1'"), second, r"chr(10) || '\1'")


def c9(c8d: str) -> str:
    """Of a column that C8 has gone over."""
    before = strip(f"regexp_extract({c8d}, {q('(?si)^(.*?)```python' + f'[{SPACES}]*.*?```')}, 1)")
    for p, f in R.TEMPLATE_PHRASES[:2]:
        before = sub(before, re2(p, f))
    # there is no fence before the first one, so the third goes to the end
    before = strip(sub(before, "(?si)我们可以使用Python代码.*$"))
    block = f"'```python' || {NL} || {c1(c8d)} || {NL} || '```'"
    return f"CASE WHEN {c1(c8d)} IS NULL THEN {c8d} WHEN {before} <> '' THEN {before} || {NL} || {NL} || {block} ELSE {block} END"
