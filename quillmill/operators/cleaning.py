"""Code-bearing rows to canonical answers and trimmed outputs.

Missing fields are empty, as columns that are null; a JSON null is the text
'None' (see ``sources.jsonio``, which keeps the two apart).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import rules as R
from quillmill.functions import text as T
from quillmill.functions.answers import clean_answer


def cleaned(rows: DataFrame, is_object: str | None = None) -> DataFrame:
    """pos, instruction, input, output, outcome: 'ok' or the first reason to reject, whose texts are null.

    ``rows`` has pos, instruction, input, output; ``is_object`` names a boolean
    column that is false where the record was no object.
    """
    norm = {c: T.normalize_row(F.coalesce(F.col(c), F.lit(""))) for c in ("instruction", "input", "output")}
    staged = rows.withColumns({f"__{c}": e for c, e in norm.items()})
    staged = staged.withColumn("question", T.question_of(F.col("__instruction"), F.col("__input")))
    staged = staged.withColumns({"code": T.first_code(F.col("__output")), "answer": clean_answer(F.col("__output"), True)})
    outcome = (
        F.when(~F.col(is_object) if is_object else F.lit(False), "not_dict")
        .when(F.col("__output") == "", "empty_output")
        .when(F.col("question") == "", "empty_question")
        .when(F.col("code").isNull(), "no_python_code")
        .when(F.col("answer").isNull() | (F.col("answer") == ""), "no_final_answer")
        .when(F.length("code") > R.LONGEST_CODE, "code_too_long")
        .otherwise("ok")
    )
    staged = staged.withColumn("outcome", outcome)
    ok = F.col("outcome") == "ok"
    told = F.struct(
        F.when(ok, R.STANDARD_INSTRUCTION).alias("instruction"),
        F.when(ok, F.concat(F.lit(R.QUESTION_PREFIX), F.col("question"))).alias("input"),
        F.when(ok, T.clean_output(T.reasoning(F.col("__output")), F.col("answer"))).alias("output"),
        "outcome",
    )
    # a generator, as a filter on the outcome must not be pushed below: it would carry all of the above once more
    return staged.select("pos", F.inline(F.array(told)))
