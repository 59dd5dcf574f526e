"""NFKC without Python nodes, against unicodedata."""

from __future__ import annotations

import os
import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmill.functions.dialect import nfkc
from quillmill.plans import catalogue

SF = "/root/testdata/sf0.001"


def differing(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = {r["k"]: r["n"] for r in df.select("k", nfkc(F.col("t")).alias("n")).toLocalIterator()}
    return [(t, got[k]) for k, t in enumerate(texts) if got[k] != (t if t is None else unicodedata.normalize("NFKC", t))]


def test_every_code_point(spark):
    # told by place in one string each, so a wrong one shows itself and its neighbours
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    texts = ["\n".join(chars[k : k + 256]) for k in range(0, len(chars), 256)] + ["".join(chars[k : k + 64]) for k in range(0, len(chars), 64)]
    assert differing(spark, texts) == []


def test_random_strings(spark):
    rng = random.Random(1)
    marks = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    made = [c for c in map(chr, range(0xC0, 0x30000)) if not "\ud800" <= c <= "\udfff" and unicodedata.normalize("NFKD", c) != c]
    jamo = [chr(c) for c in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A7, 0x11C3), 0xAC00, 0xAC01, 0xD7A3)]
    parts = [list("aeiou A1"), marks, made, jamo, ["か", "ｶ", "ﾞ", "゙", "：", "　", "é", "日", "͸", "\U0001ccd6", "ࢗ", "", "ে", "া"]]
    texts = ["".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 10))) for _ in range(100_000)] + [None, "", "a" * 100_000 + "１", "e" + "́̀" * 2000]
    assert differing(spark, texts) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["clean_v2_rows", "eval_a_summary", "number_parse", "dedup_keep_first"])
def test_no_python_in_the_plan(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan
