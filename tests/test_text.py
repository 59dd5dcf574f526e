"""Text columns against worked expectations; each quirk that must stay has a case."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quillmill.functions import answers as A
from quillmill.functions import numbers as N
from quillmill.functions import rules as R
from quillmill.functions import text as T

FENCE = "```"


@pytest.fixture(scope="module")
def value(spark):
    def one(f, *texts):
        df = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
        return df.select(f(*(F.col(f"c{i}") for i in range(len(texts)))).alias("x")).first()[0]

    return one


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (T.normalize_chat, "a\r\n\r\n\r\nb\t\t c ", "a\n\nb c"),
        (T.normalize_chat, None, ""),
        (T.normalize_chat, "x　 y\n　\nz", "x y\n\nz"),
        (T.normalize_row, " １２ − 3\r\n", "12 - 3"),
        (T.normalize_row, None, None),
        (T.normalize_answer, "￥1，300：", "1,300:"),
        (T.strip_answer, "\\({答案}。\\) $5", "答案. 5"),
        (T.answer_key, " A b\tC.；", "abc"),
        (T.with_prefix, "题目: x", "题目：题目: x"),
        (T.question_key, "题目：1.5+2", "15+2"),
        (T.question_key, "题目：15+2", "15+2"),
        (T.question_key, "题目：题目: x", "题目x"),
        (T.question_key, "-3", "3"),
        (T.style, "题目：Single apples cost how much?", "mathstyle"),
        (T.style, "题目：一共多少", "gsm8kstyle"),
        (T.style, "5 KG", "gsm8kstyle"),
        (T.style, "y''b", "mathstyle"),
        (T.style, "y'' ", "general"),
        (T.style, "nothing", "general"),
        (T.execution_result, f"x {FENCE}\n a \n{FENCE} {FENCE} {FENCE}", "a"),
        (T.execution_result, "运行上述代码，输出会是：42", "42"),
        (T.without_blocks, f"a {FENCE}python x{FENCE} b {FENCE} c", "a b"),
        (T.ablated, "# title\nkeep\nwhile x\nuse while\nfor x in y\n\nif so: z", "keep\nuse while"),
        (T.ablated, "### Python代码验证：done\nok", "done\nok"),
        (T.ablated, "我们可以使用Python代码来验证这个解\nok", "ok"),
        (T.first_code, f"{FENCE}python \n {FENCE} {FENCE}python x{FENCE}", None),
        (T.first_code, f"{FENCE}PYTHON\nx\n{FENCE}", "x"),
        (T.last_code, f"{FENCE}js\na{FENCE} {FENCE}python b {FENCE}", "b"),
        (T.last_code, f"{FENCE}js\na{FENCE}", "js\na"),
        (T.last_code, "python\nprint(1)\n因此 1", "print(1)"),
        (T.last_code, None, ""),
        (T.without_execution, "a\n运行结果：5\nb\n因此 c", "a\n\n\n因此 c"),
        (T.reasoning, f"We. {FENCE}python\nx{FENCE} after {FENCE}python y{FENCE}", f"We.\n\n{FENCE}python\nx\n{FENCE}"),
        (A.clean_answer, "\\boxed{3} and \\boxed{4.0}", "3, 4"),
        (A.clean_answer, "\\boxed{x}\nFinal Answer: none", "none"),
        (A.clean_answer, "a 1\nb 2 3\nc", "2, 3"),
        (A.clean_answer, "nothing", None),
        (A.final_segment, "\\boxed{3} and \\boxed{4}", "4"),
        (A.final_number, "答案：5-3=2", "5"),
        (A.final_number, "答案：五\n7", "7"),
        (A.simple_answer, "\\boxed{a} final answer is 3, answer is 4", "3"),
        (A.simple_answer, "none", None),
        (A.analysis_answer, "\\boxed{3} and \\boxed{4}", "4"),
        (A.analysis_answer, "the answer is 3.5", "3"),
        (N.parse_number, "1,300", 1300.0),
        (N.parse_number, "3/4", 0.75),
        (N.parse_number, "3/0", None),
        (N.parse_number, "1.5/2", None),
        (N.parse_number, "5f", None),
        (N.parse_last_number, "答案 5-3=2", 2.0),
        (N.parse_last_number, None, None),
        (N.last_plain_number, "a 1,200.5 b", "1200.5"),
        (N.canonical, "18.0", "18"),
        (N.canonical, "18.00", "18.00"),
        (N.canonical, "+07.0", "7"),
        (N.canonical, "-0.0", "0"),
    ],
)
def test_value(value, f, given, wanted):
    got = value(f, given)
    assert got == wanted


@pytest.mark.parametrize(
    ("f", "a", "b", "wanted"),
    [
        (A.analysis_equal, "1,300", "1300.0004", True),
        (N.equal_or_text, "1300", "1300.0004", False),
        (N.equal_or_text, "x ", "x", True),
        (N.equal_or_text, "None", None, True),
        (A.segments_equal, "3/0", "3/0", True),
        (A.segments_equal, "\\boxed{0.5}", "#### 1/2", True),
        (A.analysis_equal, "A b", "ab.", True),
    ],
)
def test_equality(value, f, a, b, wanted):
    assert value(f, a, b) is wanted


def test_is_close_like_math(spark):
    import math

    inf, nan = float("inf"), float("nan")
    pairs = [(1.0, 1.0), (1e6, 1e6 + 0.5), (0.0, 1e-6), (0.0, 2e-6), (inf, inf), (inf, 1.0), (nan, nan), (-inf, inf)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a double, b double").select(N.is_close(F.col("a"), F.col("b"))).collect()]
    assert got == [math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) for a, b in pairs]


SNIPPETS = ["```python", "def f (", " print (", "import os", "for x in y", "while x", "while y:", "使用return语句", "a return b", "if x:", "class five", "x\n  return 1", "from a import b", "for i in b:", "x = 5", "运行结果", "根据以上Python代码结果", "python code", "Python 验证", "plain"]


@pytest.mark.parametrize("rules", ["strict", "named"])
def test_detectors_follow_python(spark, rules):
    def plain(s):
        if rules == "named":
            return [n for n, p, f in R.NAMED_RULES if re.search(p, s, sum(getattr(re, x.upper()) for x in f))]
        return [p for p, f in R.STRICT_RULES if re.search(p, s, re.I if f else 0)] + [f"KW:{k}" for k in R.KEYWORDS if k in s.lower()]

    f = T.named_residue if rules == "named" else T.strict_residue
    df = spark.createDataFrame([(s,) for s in SNIPPETS], "s string")
    got = {r[0]: r[1] for r in df.select("s", f(F.col("s"))).collect()}
    assert got == {s: plain(s) for s in SNIPPETS}
    if rules == "named":
        assert {h for hits in got.values() for h in hits} == {n for n, _, _ in R.NAMED_RULES}
