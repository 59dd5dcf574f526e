"""Scoring of predictions: details and summaries of three evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import answers as A
from quillmill.functions import rules as R
from quillmill.functions.dialect import strip
from quillmill.functions.numbers import equal_or_text, last_plain_number
from quillmill.functions.text import last_code, normalize_answer


def first_told(*fields: str) -> Column:
    """The first non-empty field, else ''; for string columns."""
    return F.coalesce(*(F.nullif(F.col(f), F.lit("")) for f in fields), F.lit(""))


def body_question(body: str, question: str) -> Column:
    """P4."""
    return F.concat(strip(F.coalesce(F.col(body), F.lit(""))), F.lit("\n"), strip(F.coalesce(F.col(question), F.lit(""))))


def number_prompt(question: Column) -> Column:
    """P5: ends with the question."""
    return F.concat(F.lit(R.NUMBER_PROMPT), question)


def boxed_prompt(question: Column) -> Column:
    return F.concat(F.lit(R.BOXED_PROMPT), question)


def chat(question: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(R.CHAT_SYSTEM)), message("user", number_prompt(question)))


def check_mode(mode: str) -> str:
    """F21."""
    if mode not in R.MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return mode


def limited(items: DataFrame, limit: int | None) -> DataFrame:
    """data[:limit] by pos; 0 or None takes all, a negative limit leaves off as many at the end."""
    if not limit:
        return items
    if limit < 0:
        limit = max(items.count() + limit, 0)
    return items.orderBy("pos").limit(limit)


def scored_segments(items: DataFrame) -> DataFrame:
    """Idx (from 1), question, gold_raw, gold_answer, answer_raw, pred_answer, is_correct from pos, question, gold_raw, answer_raw.

    Normal form, segment and number of either side are each made once: a generator
    stands between, as projections that are merged would make them anew.
    """
    own = ["pos", "question", "gold_raw", "answer_raw"]
    norm = items.select(*own, F.inline(F.array(F.struct(normalize_answer(F.col("gold_raw")).alias("g"), normalize_answer(F.col("answer_raw")).alias("p")))))
    segments = norm.select(*own, "g", "p", F.inline(F.array(F.struct(A.final_segment(F.col("g"), True).alias("g_part"), A.final_segment(F.col("p"), True).alias("p_part")))))
    told = segments.select(*own, "g_part", "p_part", F.inline(F.array(F.struct(A.number_of(F.col("g_part"), F.col("g")).alias("gold_answer"), A.number_of(F.col("p_part"), F.col("p")).alias("pred_answer")))))
    equal = A.told_equal((F.col("p_part"), F.col("pred_answer")), (F.col("g_part"), F.col("gold_answer")))
    return told.select((F.col("pos") + 1).alias("idx"), "question", "gold_raw", "gold_answer", "answer_raw", "pred_answer", equal.alias("is_correct"))


def scored_simple(items: DataFrame) -> DataFrame:
    """Id (from 1), question, gold, pred, correct, type, model_output from pos, question, answer, model_output (P8); raw_item too where it is given."""
    told = items.withColumns({"gold": last_plain_number(F.col("answer")), "found": A.simple_answer(F.col("model_output"))})
    correct = F.coalesce(F.col("found").isNotNull() & equal_or_text(F.col("found"), F.col("gold")), F.lit(False))
    kind = F.when(F.col("found").isNull(), "extract_error").when(correct, "correct").otherwise("reasoning_error")
    return told.select((F.col("pos") + 1).alias("id"), "question", "gold", F.coalesce("found", F.lit("NONE")).alias("pred"), correct.alias("correct"), kind.alias("type"), "model_output", *(["raw_item"] if "raw_item" in items.columns else []))


def analysed(items: DataFrame) -> DataFrame:
    """T16 without execution: idx (from 0), question, gold_answer, pred_answer, is_correct, has_code, code, answer_raw."""
    told = items.withColumns({"pred_answer": A.analysis_answer(F.col("answer_raw")), "code": last_code(F.col("answer_raw"))})
    return told.select(
        F.col("pos").alias("idx"), "question", "gold_answer", "pred_answer", A.analysis_equal(F.col("pred_answer"), F.col("gold_answer")).alias("is_correct"),
        (F.col("code") != "").alias("has_code"), "code", "answer_raw",
    )


def accuracy(details: DataFrame, correct: str = "is_correct", empty: float | None = 0.0) -> DataFrame:
    """Total, correct, accuracy (unrounded; ``empty`` without rows, None to raise)."""
    right = F.coalesce(F.sum(F.col(correct).cast("bigint")), F.lit(0))
    none = F.raise_error(F.lit("no items to score")).cast("double") if empty is None else F.lit(empty)
    return details.agg(F.count("*").alias("total"), right.alias("correct")).withColumn("accuracy", F.when(F.col("total") > 0, F.try_divide("correct", "total")).otherwise(none))


def analysis_summary(details: DataFrame) -> DataFrame:
    """A11, one pass; executable counts where ``code_executable`` is there."""
    ran = F.col("code_executable") if "code_executable" in details.columns else F.lit(None).cast("boolean")
    sums = details.agg(
        F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), F.count_if("has_code").alias("code_count"), F.count_if(F.coalesce(ran, F.lit(False))).alias("executable_code_count"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.withColumns({"accuracy": rate("correct", "total"), "code_generation_rate": rate("code_count", "total"), "code_executability_rate": rate("executable_code_count", "code_count")})


def wrong_ids(details: DataFrame, limit: int = 50) -> DataFrame:
    """F19."""
    return details.where(~F.col("is_correct")).select("idx").orderBy("idx").limit(limit)
